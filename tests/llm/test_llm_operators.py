"""Each operator against a brute-force version, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varguard.llm.chunk_dedup import chunk_ids, cut_points, exact_dedup
from varguard.llm.common import connected_components
from varguard.llm.e8 import decode, shortest_vectors
from varguard.llm.lattice_dedup import embedding_groups
from varguard.llm.license_scan import scan_licenses
from varguard.llm.pairwise_quality import score_quality
from varguard.llm.pfair_mix import counts_before, edf, edf_period, mix_sources, phases, whole_weights
from varguard.llm.piece_tokenizer import Tokenizer, decode_ids, encode_texts, load_vocabulary
from varguard.llm.repeat_spans import Block, pack, remove_repeats, unpack
from varguard.llm.simhash import simhash_groups
from varguard.llm.token_spans import RULES, allocate, attribute_tokens, field_ends, lines, sentences, token_ends
from varguard.llm.url_filter import build_cascade, judge_urls

SCHEMA = "doc_id long, text string, source string, block string, slot int, score string, key long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and tion er on ing law code river stone lamp ember quiet".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 200, 15, 40, 3, 90, 120)]
    passage = prose(rng, 30)
    out = [*base, base[0], base[0].replace(" ", "\t\n", 3), base[1] + " end", base[2] + " " + passage, passage + "\n" + base[3], passage]
    out += [None, "", " \n", "Σ Ünder ▁ ﬁ\U0001f600\x00x", "x" * 3000, "word " * 2000, base[5], prose(rng, 9000), "It is under the MIT license. Mit  License!"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "clash", i, "clash", 1) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "s0", None, None, None, None), (None, texts[0], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def all_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def components(n, linked):
    at = list(range(n))

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i, j in linked:
        at[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs):
    rows = all_rows(docs)

    def fp(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))

    fps = [fp(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = sorted(((i, format(fps[k], "016x"), least[root[k]]) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in simhash_groups(docs).collect()), key=str) == want


def test_simhash_pairs_are_complete(spark):
    from varguard.llm.simhash import near_pairs

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4)}
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = {(r["a"], r["b"]) for r in near_pairs(spark.createDataFrame([(as_long(x),) for x in fps], "fp long"), 3).collect()}
    want = {tuple(sorted((as_long(x), as_long(y)))) for x in fps for y in fps if x < y and bin(x ^ y).count("1") <= 3}
    assert pairs == want


def test_url_filter(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = ["http://Example.COM/en/x?q", "https://a.www.example.com/en/", "ftp://b.com", "x.com/", None, "", "://", "h://net/es/", "h://xnet/es/", "h://n.net/es", "h://q.com?/en/", "h://example.com/EN/#a", "h://a..com/z"]
    urls += [f"http://h{i}.org/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], None), (0, urls[0], "")], "page_id long, url string, host string")

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:n].lower(), rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(r), v, r) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        _, verdict, rule = max(fits, default=(0, "allow", None))
        return host, path, rule, verdict

    got = sorted((tuple(r) for r in judge_urls(pages, rules).collect()), key=str)
    assert got == sorted(((r["page_id"], *brute(r["url"])) for r in pages.collect()), key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key LIKE '%7'")
    cascade = build_cascade(listed, keys)
    hashes = keys.select("key", F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit("url")).alias("b")).toPandas()
    found = cascade.contains(hashes["a"].to_numpy(), hashes["b"].to_numpy())
    assert (found == hashes["key"].str.endswith("7").to_numpy()).all() and len(cascade.levels) > 2


def test_exact_dedup(docs):
    rows = all_rows(docs)
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    want = []
    for (i, _), n in zip(rows, norm, strict=True):
        group = [rows[k][0] for k in range(len(rows)) if norm[k] == n]
        keep = min((x for x in group if x is not None), default=None)
        want.append((i, keep, len(group), i is not None and i == keep, hashlib.sha256(n.encode()).hexdigest()))
    want.sort(key=str)
    assert sorted((tuple(r) for r in exact_dedup(docs).collect()), key=str) == want
    # identifiers of one byte collide; they are widened until none does
    assert sorted((tuple(r) for r in exact_dedup(docs, id_bytes=1).collect()), key=str) == want
    assert exact_dedup(docs.limit(0)).count() == 0


def test_chunks_follow_content():
    data = random.Random(2).randbytes(200_000)
    ends = cut_points(data)
    assert ends[-1] == len(data) and b"".join(chunk_ids(data, 16)[1]) == data
    assert set(chunk_ids(data, 16)[0][2:-2]) <= set(chunk_ids(b"put before" + data, 16)[0])
    assert max(b - a for a, b in zip(ends, ends[1:])) <= 16384  # noqa: B905
    assert cut_points(b"") == [] and cut_points(b"\x07" * 50_000)[-1] == 50_000


def test_license_scan(spark, docs):
    import re

    extra = ["Licensed under CC BY-NC 4.0.", "released under THE mit-license", "MIT\nLicense mit license", "general public licenses", "license mit", "Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3."]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    got = {}
    for r in scan_licenses(table).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in all_rows(table):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = {k: [j for j in range(len(words)) if words[j : j + len(p.split())] == p.split()] for k, p in phrases.items()}
        flat = sorted(x for v in at.values() for x in v)
        base = ",".join(sorted(k for k, v in at.items() if v))
        want = (len(words), len(flat), flat[0] if flat else None, flat[-1] if flat else None, base)
        assert any((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want for r in got[i])
        assert all(0 <= r["score"] <= 1 for r in got[i])
    assert got[1000][0]["labels"] == "cc-by-nc" and got[1000][0]["score"] == 1.0 and got[1006][0]["labels"] == "gpl"
    assert sum(map(len, got.values())) == table.count() and scan_licenses(table.limit(0)).count() == 0


def test_pfair_windows_and_deviation():
    slots = {"a": 1, "b": 5, "c": 44, "d": 450}
    order, period = edf_period(slots), sum(slots.values())
    assert sorted(x for v in order.values() for x in v) == list(range(period))
    for k, m in slots.items():
        for j, slot in enumerate(order[k], 1):
            assert (j - 1) * period // m <= slot < -(-j * period // m)
        for t in range(period + 1):
            assert abs(sum(x < t for x in order[k]) - t * m / period) < 1


def test_license_scan_finds_phrases_whatever_the_corpus(spark):
    """A mandatory phrase is found though the rarest words of the whole template stand outside it or nowhere."""
    bsd, mpl = "Redistribution and use in source and binary forms are permitted provided that", "This file is released under the Mozilla Public License"
    common = ["license public", "the license of the public", "mozilla public the license"] * 3
    for others in ([], common, ["without modification are permitted", "subject to the terms", *common]):
        table = spark.createDataFrame(list(enumerate([bsd, mpl, *others])), "doc_id long, text string")
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(table).collect()}
        assert got[0] == ("bsd", round(8 / 14, 6)) and got[1] == ("mpl", round(4 / 9, 6))
        assert all(got[i] == ("", 0.0) for i in range(2, len(got)))


@pytest.mark.parametrize("n, most", [(20, 4000), (500, 1500), (1200, 1000)])
def test_schedule_follows_the_given_weights(n, most):
    """One source of weight 1/2 among n, one of an odd weight: less than one block off at every slot, over many pieces."""
    weights = {"a": 0.5, "b": 0.1 / 3} | {f"c{i}": (0.5 - 0.1 / 3) / (n - 2) for i in range(n - 2)}
    spans, places = phases(dict.fromkeys(weights, most), weights, 100)
    length = next(s[5] for s in spans if s[1] == 0)
    assert length >= 2 * most - 2
    at = {}
    for k, f, i, x in places:
        if f == 0:
            at.setdefault(k, []).append((i, x))
    total = sum(map(Fraction, weights.values()))
    for k, w in weights.items():
        share = Fraction(w) / total
        for i, (j, x) in enumerate(sorted(at.get(k, []))):
            assert i == j
            assert abs(i - share * x) < 1 and abs(i + 1 - share * (x + 1)) < 1
        assert abs(len(at.get(k, [])) - share * length) < 1


@pytest.mark.parametrize("seed", range(20))
def test_pieces_meet_within_all_windows(seed):
    """Wherever a phase is cut, blocks before and after the cut fit their windows."""
    rng = random.Random(seed)
    n = rng.choice([2, 3, 7, 20])
    m = whole_weights([rng.choice([rng.random() + 0.01, 1.0, rng.randrange(1, 9) / 7]) for _ in range(n)])
    cuts = [0, *sorted(rng.sample(range(1, 400), 60)), 400]
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        at, end = counts_before(a, m, sum(m)), counts_before(b, m, sum(m))
        for slot, i in enumerate(edf(m, sum(m), a, b, at, end), a):
            assert at[i] * sum(m) // m[i] <= slot < -(-(at[i] + 1) * sum(m) // m[i])
            at[i] += 1
        assert at == end


def test_phases_place_every_block_once():
    blocks = {"a": 7, "b": 2500, "c": 130, "d": 0}
    spans, places = phases(blocks, {"a": 1.0, "b": 2.0, "c": 3.0, "d": 1.0}, 100)
    at = {(s, f, i): x for s, f, i, x in places}
    used = []
    for s, f, first, last, m, period, base in spans:
        used += [base + j // m * period + at[s, f, j % m] for j in range(last - first)]
    assert sorted(used) == list(range(sum(blocks.values())))


def test_mix_sources(spark, docs):
    out = mix_sources(docs, {"s0": 3.0, "s1": 1.0}, block_chars=100, period=20)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "source", "score", "key", "block", "phase", "release", "deadline", "slot"]
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(all_rows(docs), key=str)
    assert len(rows) == docs.count() and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in by_slot.values())
    assert mix_sources(docs.limit(0), {}).count() == 0


def test_mix_sources_without_broadcast(docs, monkeypatch):
    """A schedule beyond the broadcast bound is joined by shuffle, with the same result."""
    import varguard.llm.pfair_mix as m

    want = sorted(mix_sources(docs, {"s0": 3.0}, block_chars=100, period=20).collect(), key=str)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    assert sorted(mix_sources(docs, {"s0": 3.0}, block_chars=100, period=20).collect(), key=str) == want


def test_e8_decodes_to_the_nearest_point():
    shell = shortest_vectors()
    assert len({tuple(v) for v in shell}) == 240 and np.allclose((shell**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = decode(x)
    assert np.allclose(p.sum(axis=1) % 2, 0) and (((2 * p) % 2).std(axis=1) == 0).all()
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - p[:, None] - shell) ** 2).sum(axis=2) + 1e-9).all()


def test_embedding_groups(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 32))
    v = np.concatenate([centre[i % 30] + rng.normal(size=32) * 0.25 for i in range(300)]).reshape(300, 32)
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)]
    rows += [(300, v[0].tolist(), 0), (300, v[0].tolist(), 0), (301, (v[0] * 1e-200).tolist(), 0), (None, v[1].tolist(), 1)]
    odd = [(400, None, 0), (401, [], 0), (402, [0.0] * 32, 0), (403, [None] * 32, 0), (404, [float("nan")] * 32, 0), (405, [float("inf")] * 32, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component_id int")
    x = np.array([r[1] for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    for cell_rows in (4096, 3):  # with and without split cells
        got = embedding_groups(table, cell_rows=cell_rows).collect()
        assert len(got) == len(rows) + len(odd)
        links = {r["vec_id"]: r["n_links"] for r in got}
        found = sum(links[i] for i in range(300))
        true = near[:300].sum()
        assert 0.9 * true <= found <= true
        assert all(links[i] <= near[i].sum() for i in range(300))
        assert all(links[i] == 0 for i in range(400, 406)) and links[406] == links[407] == 1
        assert {r["component_id"] for r in got if r["vec_id"] in (300, 301, 0)} == {0}
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_groups(table.limit(0)).count() == 0


def brute_repeats(rows, k):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_remove_repeats(spark, docs):
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str)
    assert got == brute_repeats(all_rows(docs), 13) and sum(r[2] for r in got) > 400
    assert remove_repeats(docs.limit(0)).count() == 0


def test_remove_repeats_mends_shared_hashes(spark, docs, monkeypatch):
    """With a few bits of hash nearly all windows collide; the result is the same."""
    import varguard.llm.repeat_spans as m

    table = docs.where("doc_id IN (0, 2, 3, 7, 8, 10, 11, 12)")
    real = m.Words.windows
    monkeypatch.setattr(m.Words, "windows", lambda self, w, k, name: real(self, w, k, name) & np.uint64(0xFF0000000000003F if name == "edge" else 0xFFFFFFFFFFFFFFFF))
    rows = [(i, (t or "").encode()) for i, t in all_rows(table)]
    import pyarrow as pa

    docs_table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    wrong = m.verify(13, np.array([], np.uint64))(None, docs_table, pa.table({"source_id": [rows[0][0]], "path": [rows[1][1]]}))
    assert wrong.num_rows > 0
    bad = np.array(wrong["edge"].to_pylist(), np.int64).view(np.uint64)
    block = Block(docs_table, 13, bad)
    assert not np.isin(block.edge, bad).any()


def test_edges_pack_and_unpack():
    rng = np.random.default_rng(0)
    for bits in (8, 10, 16):
        part = 137
        edges = (rng.integers(0, 1 << 40, 50).astype(np.uint64)) | (np.uint64(part) << np.uint64(64 - bits))
        ids = np.sort(rng.integers(-5, 1 << 50, 50))
        e, i = unpack(pack(edges, ids, bits), part, bits)
        assert (e == edges).all() and (i == ids).all()


def test_quality_learns_and_never_sees_held_out(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, 80) + "." if i % 4 else "BUY!! " * 40 + "###", "en" if i % 4 else "xx", i % 4 > 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows] + [(900, None, None), (901, "", None), (None, "x", None)], "doc_id long, text string, score string")
    labels = [(i, int(q)) for i, _, _, q in rows] + [(5, None), (None, 1), (12345, 0)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in score_quality(docs, table(labels)).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == int(q) for i, _, _, q in rows)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    lies = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    again = {r["doc_id"]: r["score"] for r in score_quality(docs, table(lies)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert {r["score"] for r in score_quality(docs, table([])).collect()} == {0.5}


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def test_tokenizer_finds_the_best_path(vocabulary):
    made = Tokenizer(vocabulary)
    score = {p[0]: (p[1], i) for i, p in enumerate(vocabulary.pieces) if p}
    rng = random.Random(4)
    for text in ["the stone lamp", "a  b", "ember\nquiet", "ﬁÅ\U0001f600", " lead", "trail ", "   ", "x"] + [prose(rng, 6) for _ in range(5)]:
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [None] * len(marked)
        for end in range(1, len(marked) + 1):
            ways = [best[s] + score[marked[s:end]][0] for s in range(max(0, end - 40), end) if marked[s:end] in score]
            if marked[end - 1] not in score:
                ways.append(best[end - 1] + made.unknown)
            best[end] = max(ways)
        total, run = 0.0, False
        data = bytearray()
        for i in np.frombuffer(made.encode(text), np.int32).tolist():
            if vocabulary.pieces[i]:
                total += vocabulary.pieces[i][1]
            else:
                data += made.text_of[i]
        total += made.unknown * len(data.decode())
        assert not run and abs(total - best[-1]) < 1e-3


def test_tokenizer_round_trip(docs, vocabulary):
    out = encode_texts(docs, vocabulary)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] is not False for r in rows)
    assert all((r["ids"] is None) == (r["n_tokens"] is None) for r in rows)
    back = sorted(((r["doc_id"], r["text"]) for r in decode_ids(out, vocabulary).collect()), key=str)
    assert back == sorted(all_rows(docs), key=str)
    assert encode_texts(docs.limit(0), vocabulary).count() == 0


def test_token_spans(docs):
    got = {}
    for r in attribute_tokens(docs.where("doc_id <> 3"), split=sentences).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in all_rows(docs):
        if i is None or i == 3:
            continue
        sections = sorted(got[i], key=lambda r: r["section"] or 0)
        if not t:
            assert [(r["section"], r["n_tokens"]) for r in sections] == [(None, 0)]
            continue
        assert sum(r["n_tokens"] for r in sections) == len(token_ends(t, None))
        assert [sections[0]["start"], sections[-1]["stop"]] == [0, len(t)]
        assert all(a["stop"] == b["start"] for a, b in zip(sections, sections[1:]))  # noqa: B905
    assert attribute_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", RULES)
def test_token_counts_of_sections_are_brute_force(spark, rule):
    """Every token is dealt by hand, byte by byte; sections of a few bytes give tokens that cross several."""
    texts = ["One line.\nTwo lines, antidisestablishmentarianism!\nDrei Zeilen: Größe \U0001f600 ok.", "a  b\n\n\nc" * 5, "x", None, "", "word " * 400]
    cuts = {"lines": lines, "fours": lambda data: np.append(np.arange(4, len(data), 4), len(data))}
    texts_of_ascii = [t for t in texts if t is None or t.isascii()]
    for name, rows in (("lines", texts), ("fours", texts_of_ascii)):
        table = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(rows)], "doc_id long, text string, section string, id int")
        got = sorted(tuple(r) for r in attribute_tokens(table, rule=rule, split=cuts[name]).where("section IS NOT NULL").collect())
        want = []
        for i, t in enumerate(rows):
            data = (t or "").encode()
            ends = cuts[name](data).tolist() if data else []
            owner_of_byte = [k for k, (a, b) in enumerate(zip([0, *ends], ends)) for _ in range(a, b)]  # noqa: B905
            n_tokens, n_crossing, start = Counter(), Counter(), 0
            for end in token_ends(t, None).tolist() if data else []:
                held = owner_of_byte[start:end]
                best = max(sorted(set(held)), key=held.count)
                n_tokens[{"first": held[0], "last": held[-1], "most": best}[rule]] += 1
                n_crossing.update(set(held) if len(set(held)) > 1 else ())
                start = end
            for k, (a, b) in enumerate(zip([0, *ends], ends)):  # noqa: B905
                want.append((i, k, len(data[:a].decode()), len(data[:b].decode()), n_tokens[k], n_crossing[k]))
        assert got == want and sum(r[5] for r in got) > 0


def test_allocation_rules():
    tokens, sections = np.array([3, 10, 11, 20]), np.array([5, 6, 11, 20])
    starts = [0, 3, 10, 11]
    for rule in RULES:
        for k, owner in enumerate(allocate(tokens, sections, rule).tolist()):
            bounds = [0, *sections.tolist()]
            shares = [max(0, min(tokens[k], bounds[s + 1]) - max(starts[k], bounds[s])) for s in range(4)]
            held = [s for s in range(4) if shares[s]]
            assert owner == {"first": held[0], "last": held[-1], "most": int(np.argmax(shares))}[rule]
    text, ends = field_ends("títle", None, "body")
    assert text == "títle\n\nbody" and ends.tolist() == [7, 8, 12]


def test_license_and_repeat_twins_on_odd_tables(docs):
    """The SQL twins agree on null, empty, very long and repeated rows, where both find something."""
    import duckdb

    from varguard.llm.queries import LICENSE_SQL, REPEAT_SQL

    con = duckdb.connect()
    table = docs.select("doc_id", "text").where("text IS NULL OR NOT contains(text, '\\0')")
    documents = table.toPandas()  # noqa: F841 (read by the SQL)
    con.register("documents", documents)
    for df, sql, some in ((scan_licenses(table), LICENSE_SQL, "n_base"), (remove_repeats(table), REPEAT_SQL, "n_removed")):
        got = sorted((tuple(r) for r in df.collect()), key=str)
        want = sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=str)
        assert got == want and any(r[df.columns.index(some)] for r in got)
