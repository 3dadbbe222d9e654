"""Resampling, neighbour search and phrase mining against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varguard.llm import phrase_mining
from varguard.llm.block_neighbours import Block, nearest_neighbours, small_copy, tile_bounds
from varguard.llm.phrase_mining import Chunk, collocations, from_planes, planes
from varguard.llm.target_resample import regular_samples, resample_to_target

WORDS = "the of and tion river stone lamp ember quiet law code".split()


def prose(rng: random.Random, n: int, ends: str = " ") -> str:
    return "".join(rng.choice(WORDS) + rng.choice(ends) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    texts += [None, "", " \t", "É x-y\x7fz Ünder_score 12a", texts[0], texts[0].upper(), "long " * 5000, prose(rng, 4000)]
    rows = [(i, t, "clash", i, 1, "x") for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, None, None), (3, texts[4], None, None, None, None)] + [(None, t, None, None, None, None) for t in (texts[5], texts[5], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, place int, range int, rank string").repartition(5)


# ------------------------------------------------------------------ resampling
def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(rows, target, percent, least):
    raw, aim = Counter(), Counter()
    for _, t in rows:
        raw.update(features(t)[1])
    for t in target:
        aim.update(features(t)[1])
    n_raw, n_aim = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (n_raw + 10000) / ((raw[b] + 1) * (n_aim + 10000))))
    out = []
    for i, t in rows:
        n, fs = features(t)
        w = math.floor(sum(map(gain, fs)) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling_like_brute_force(spark, docs, percent):
    target = ["river stone river stone lamp", None, "", "quiet law"]
    got = resample_to_target(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, min_words=5)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target, percent, 5)


def test_resampling_of_equal_rows_and_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    same = spark.createDataFrame([(None, "a b c", 1)] * 3000 + [(7, "a b c", 1)], "doc_id long, text string, pos int").repartition(6)
    got = resample_to_target(same, target, percent=50, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1501)) and len(got) == 3001
    assert resample_to_target(same.limit(0), target).count() == 0


def test_equal_keys_are_spread_over_ranges(spark):
    rows = spark.range(4000, numPartitions=4).selectExpr("5L AS down", "1L AS no_id", "CAST(NULL AS LONG) AS id", "3L AS n_features", "id AS place")
    samples = regular_samples(rows.sortWithinPartitions("down", "place"), 100)
    assert 36 <= len(samples) <= 44 and len({s[-1] for s in samples}) == len(samples)


# ------------------------------------------------------------------ neighbours
def brute_neighbours(rows, k):
    ok = [(i, [float(x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, x) in enumerate(ok):
        if i is None or i % 20:
            continue
        near = []
        for m, (j, y) in enumerate(ok):
            if m != n and len(x) == len(y):
                s = 0.0
                for a, b in zip(x, y, strict=True):
                    s += a * b
                near.append((-s, j is None, j or 0, j))
        out += [(i, r, e[3], -e[0]) for r, e in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id long, embedding array<float>, node string, rank int").repartition(7)


@pytest.mark.parametrize("k,block", [(20, 64), (3, 4096), (200, 16)])
def test_neighbours_like_brute_force(spark, k, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, base[0].tolist()) for i in range(120)]  # a hot vector, its queries among them
    rows += [(400 + i, (base[1] * (1 + i)).tolist()) for i in range(10)] + [(500 + i, rng.integers(-1, 2, 12).astype(float).tolist()) for i in range(60)]  # ties
    rows += [(600, None), (620, []), (640, [0.0] * 12), (660, [1.0] * 11 + [None]), (680, [float("nan")] * 12), (700, [float("inf")] * 12)]
    rows += [(720, [1.0, 2.0]), (721, [2.0, 1.0]), (None, base[2].tolist()), (740, base[3].tolist()), (740, base[4].tolist()), (760, [1e-40] * 12), (780, [3e38] * 12)]
    got = nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=k, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_neighbours(kept, k)


def test_neighbours_of_few_rows(spark):
    assert nearest_neighbours(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_neighbours(vectors(spark, [(20, [1.0, 0.5])]), F.col("vec_id") % 20 == 0).count() == 0
    same = vectors(spark, [(20, [1.0, 0.5])] * 3)  # repeated rows are candidates, a row isn't its own
    got = nearest_neighbours(same, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 20, 1.25)] * 3 + [(2, 20, 1.25)] * 3


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(40, dim)) * 10.0 ** rng.integers(-20, 20, (40, 1)), rng.standard_cauchy((30, dim))
    made = []
    for v in (x, y):
        q, *facts = small_copy(v)
        made.append(Block(dim, np.arange(len(v)).tobytes(), q.tobytes(), np.stack(facts).tobytes()))
    low, high = tile_bounds(made[0], made[1], slice(0, 30))
    exact = x @ y.T
    assert (low <= exact).all() and (exact <= high).all()


# ------------------------------------------------------------------ phrases
def brute_phrases(rows, least, most, top, percent):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in long.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    held[p[i : i + size]] = max(held[p[i : i + size]], a)
        rows = []
        for p, a in long.items():
            if held[p] and 100 * held[p] >= percent * a:
                continue
            s, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(2)
    rows = [(rng.choice(["en", "de", None]), prose(rng, rng.randrange(200), "     \t,.;\n")) for _ in range(80)]
    rows += [("en", "New York City! " * 50), (None, "New  York\tcity " * 31), ("fr", None), ("fr", ""), ("blank", " \t"), ("", "a b " * 40), ("en", "Œuvre\x85x\xa0y çà " * 35)]
    return rows + [("de", "very long text " * 4000), ("und", "river stone " * 20), ("zz", "x y " * 29)]


@pytest.mark.parametrize("chunk_bytes,top", [(4 << 20, 2000), (300, 5)])
def test_phrases_like_brute_force(spark, chunk_bytes, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, lang, t, 1, "clash") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string")
    got = collocations(docs.repartition(4), least=30, top=top, chunk_bytes=chunk_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 30, 4, top, 80)


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(docs).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).count() == 0


def test_colliding_fingerprints_are_told_apart_by_words(monkeypatch):
    text = b"ab cd ab  cd\nxx cd ab\nab cd"
    monkeypatch.setattr(phrase_mining, "mixed", lambda x, salt: np.zeros(len(x), np.uint64))  # all collide
    chunk = Chunk("en", text)
    ids = chunk.word_ids()
    assert len(set(ids.tolist())) == 3 and len({i for i, w in zip(ids.tolist(), text.split(), strict=True) if w == b"ab"}) == 1
    at, fp = chunk.frequent(2, np.zeros(1, np.uint64))
    counts = Counter()
    for phrase, n in chunk.phrases(2, at, fp, ids):
        counts[phrase] += n
    assert counts == {b"ab cd": 3, b"cd ab": 2, b"xx cd": 1}


def test_phrases_are_exact_whatever_fingerprints_share(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string")
    monkeypatch.setattr(phrase_mining, "gram_bits", lambda words: 6)  # 64 fingerprints in all
    assert sorted(map(tuple, collocations(docs, chunk_bytes=2000).collect())) == brute_phrases(rows, 30, 4, 2000, 80)


def test_rows_between_passes_follow_ranges_not_phrases(spark, monkeypatch):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    docs = spark.createDataFrame([("en", " ".join(words))] * 40, "lang string, text string").repartition(4)
    seen = {}

    def counted(df, name, write=phrase_mining.written):
        out = write(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(phrase_mining, "written", counted)
    collocations(docs, chunk_bytes=4000)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seen["counts"] == 400 + 399 + 398 + 397 and seen["chunks"] >= 10
    assert seen["phrases"] <= 2 * seen["chunks"] * ranges < seen["chunks"] * 799


def test_fingerprints_are_sent_as_short_differences():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 35, 20_000, np.uint64))
    data = phrase_mining.packed(keys)
    assert (phrase_mining.unpacked(data) == keys).all() and len(data) < 3.2 * len(keys)
    assert phrase_mining.gram_bits(5_000_000_000) == 41 and phrase_mining.gram_bits(1 << 60) == 64


def test_planes_round_trip():
    for kind in (np.uint64, np.uint32):
        x = np.sort(np.random.default_rng(1).integers(0, np.iinfo(kind).max, 1000, kind))
        assert (from_planes(planes(x), kind) == x).all()


# ------------------------------------------------------------------ mended operators
def test_two_vocabularies_in_one_session(spark):
    from varguard.llm.piece_tokenizer import Vocabulary, encode_texts, load_vocabulary

    big = load_vocabulary()
    docs = spark.createDataFrame([(1, "the of")], "doc_id long, text string").coalesce(1)
    first = encode_texts(docs, big).first()["ids"]
    a, b = first[0], first[-1]
    swapped = list(big.pieces)
    swapped[a], swapped[b] = swapped[b], swapped[a]  # the same length and last piece
    other = Vocabulary(**{**vars(big), "pieces": tuple(swapped)})
    second, again = (encode_texts(docs, v).first()["ids"] for v in (other, big))
    swap = {a: b, b: a}
    assert first == again and second == [swap.get(i, i) for i in first] and first != second


def test_a_hot_id_does_not_pass_the_training_bound(spark, monkeypatch):
    from varguard.llm import pairwise_quality as q

    seen = []
    monkeypatch.setattr(q, "fit", lambda x, label, ids: seen.append(len(x)) or q.PairwiseModel([0.0] * q.N_FEATURES, [1.0] * q.N_FEATURES, [0.0] * q.N_FEATURES, 0.0))
    hot = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.range(2000).selectExpr(f"{hot}L AS doc_id", "concat('text ', repeat('x', CAST(id AS INT) % 500), id) AS text")
    q.train_quality(docs, spark.createDataFrame([(hot, 1)], "doc_id long, quality int"), max_train=10)
    assert seen == [10]


def test_rows_without_id_fall_into_several_substreams(spark, monkeypatch):
    from varguard.llm import pfair_mix

    monkeypatch.setattr(pfair_mix, "ROWS_PER_STREAM", 50)
    docs = spark.range(600).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text", "'s' AS source", "id AS _mix_b", "'mine' AS _mix_h")
    out = pfair_mix.mix_sources(docs, {"s": 1.0}, block_chars=100)
    assert out.count() == 600 and out.where("_mix_h <> 'mine'").count() == 0 and out.select("_mix_b").distinct().count() == 600
    assert out.columns == [*docs.columns, "block", "phase", "release", "deadline", "slot"]


@pytest.mark.parametrize("cosine", [0.9, 0.8])
def test_planted_pairs_are_found_at_any_cosine(spark, cosine):
    from varguard.llm.lattice_dedup import embedding_groups

    rng = np.random.default_rng(8)
    n, dim = 1500, 48
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = cosine + np.where(np.arange(n) % 3 == 0, -0.002, 0.002)  # a third just below: never linked
    z = c[:, None] * x + np.sqrt(1 - c * c)[:, None] * y
    rows = [(2 * i, v.tolist()) for i, v in enumerate(x)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(z)]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6), cosine=cosine)
    linked = {r["vec_id"] for r in got.where("n_links = 1 AND vec_id % 2 = 1 AND component_id = vec_id - 1").collect()}
    true = {2 * i + 1 for i in range(n) if i % 3}
    assert not linked - true and len(linked) >= 0.95 * len(true)


def test_licence_twin_on_phrases_apart_from_their_templates(spark):
    import duckdb

    from varguard.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses
    from varguard.llm.queries import LICENSE_SQL

    texts = [
        "Redistribution and use in source and binary forms are permitted provided that",
        "released under the Mozilla Public License", "license public license public " * 20, "modification binary permitted subject to terms", None, "", "MIT License mit license",
        "permission is hereby granted, free of charge, to any person", "Apache License. Licensed under the Apache License, Version 2.0", "x general public license " * 3,
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None), (3, texts[1], None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, labels string").toPandas()
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string"), BASE_PHRASES, TEMPLATES)
    con = duckdb.connect()
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({LICENSE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r[0]: r[6] for r in want if r[0] in (0, 1)} == {0: "bsd", 1: "mpl"}


def test_licence_index_of_many_templates_is_brute_force(spark):
    """Hundreds of templates from a table, words shared among them; rows with odd ids and clashing columns."""
    from varguard.llm.license_scan import scan_licenses, templates_of

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["ß", "the", "the", "the"]
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(3, 14))
        at = rng.randrange(len(words))
        rows.append((f"L{i % 90:02d}", " ".join(words).replace("w", "W"), " ".join(words[at : at + rng.randint(1, 4)])))
    rows += [rows[0], ("phrase", None, "Only-this phrase"), ("repeat", None, "ha ha ha"), (None, "a b", "a"), ("none", "a b", None), ("none", "a b", "  ")]
    templates = templates_of(spark.createDataFrame(rows, "label string, text string, mandatory string"))
    assert len(templates) == len({(t.label, t.text, t.mandatory) for t in templates}) <= 402 and "none" not in {t.label for t in templates}

    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30, 60]))) for _ in range(60)]
    texts += [t.text + " end" for t in templates[:40]] + [None, "", "ha ha ha ha", "only this, PHRASE", "the " * 5000, " ".join(rng.choices(vocabulary, k=4000))]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _words string, labels int")
    base = templates[:30]
    got = {r["doc_id"]: r for r in scan_licenses(docs, base, templates[30:]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = []
        for n, x in enumerate(templates):
            k = len(x.phrase)
            for p in range(len(words) - k + 1):
                if words[p : p + k] == x.phrase:
                    s = p - x.phrase_at
                    same = sum(a == b for a, b in zip(words[s : s + len(x.words)], x.words)) if s >= 0 else 0  # noqa: B905
                    found.append((n, s, same / len(x.words)))
        starts = [s for n, s, _ in found if n < 30]
        best = max([f[2] for f in found if f[0] >= 30], default=0.0)
        r = got[None if i == 3 else i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({templates[n].label for n, _, _ in found if n < 30}))
        assert r["labels"] == ",".join(sorted({templates[n].label for n, _, _ in found}))
        assert r["score"] == pytest.approx(max(best, 0.5) if starts else best, abs=1e-6)


def test_licence_templates_are_checked(spark):
    from varguard.llm.license_scan import scan_licenses, templates_of

    schema = "label string, text string, mandatory string"
    with pytest.raises(ValueError, match="not in the text"):
        templates_of(spark.createDataFrame([("x", "some license", "other license")], schema))
    with pytest.raises(ValueError, match="more than 1 "):
        templates_of(spark.createDataFrame([("x", "a", "a"), ("x", "b", "b")], schema), most=1)
    none = templates_of(spark.createDataFrame([], schema))
    rows = scan_licenses(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"), none, none).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0, None, None, "", "", 0.0)]


def test_quality_fit_is_the_pairs_optimum_and_scores_follow_it(spark):
    from varguard.llm import pairwise_quality as q

    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, q.N_FEATURES))
    label = (x[:, 0] + 0.8 * x[:, 3] + rng.normal(size=120) > 0.2).astype(int)
    ids = np.arange(120)
    model = q.fit(x, label, ids)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = [(g, bad[zlib.crc32(f"{g}:{j}".encode()) % len(bad)]) for g in good for j in range(q.PAIRS_EACH)]
    diff = np.array([z[g] - z[b] for g, b in pairs])

    def loss(w):
        return np.logaddexp(0, -diff @ w).mean() + q.L2 / 2 * w @ w

    w = np.array(model.weights)
    for i in range(len(w)):  # no step along any weight lowers the loss
        for h in (1e-3, -1e-3):
            assert loss(w + h * np.eye(len(w))[i]) >= loss(w) - 1e-12
    ranked = np.sort(z @ w)
    assert abs(model.threshold - (ranked[len(bad) - 1] + ranked[len(bad)]) / 2) < 1e-9
    assert (model.scores(x) >= 0.5).sum() == len(good)
    texts = ["A plain text.", "", "BUY!!! $$$ " * 9, "x" * 500, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in q.with_score(docs, model, score_col="s").collect()}
    for i, t in enumerate(texts):
        f = (np.array(q.features((t or "").encode())) - model.mean) / model.scale
        assert abs(got[i] - 1 / (1 + math.exp(min(500, max(-500, model.threshold - f @ w))))) < 1e-9


def test_every_link_of_a_hot_cell_is_counted(spark):
    """Near copies that share their cells, in parts and over several Arrow batches; whole-number and float vectors."""
    from varguard.llm.lattice_dedup import embedding_groups

    rng = np.random.default_rng(12)
    v = np.concatenate([np.round(100 * (rng.normal(size=24) + rng.normal(size=(220, 24)) * 0.02)), np.round(100 * rng.normal(size=(60, 24)))])
    v[5], v[6] = v[4], -v[4]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for kind in ("int", "float", "double"):
            table = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
            table = table.selectExpr("vec_id", f"CAST(embedding AS array<{kind}>) AS embedding", "'x' AS node", "1 AS key")
            for cell_rows in (4096, 40):
                got = {r["vec_id"]: r["n_links"] for r in embedding_groups(table, cell_rows=cell_rows).collect()}
                assert [got[i] for i in range(len(v))] == near.tolist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_rule_table_beyond_the_bound_is_judged_in_passes(spark, monkeypatch):
    from varguard.llm import url_filter as u

    urls = [f"http://s{i % 7}.h{i}.{'com' if i % 3 else 'net'}/p{i % 11}/x" for i in range(1500)] + [None, "", "h://"]
    pages = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(urls)], "page_id long, url string, rule string")
    rules = [("block" if i % 4 else "allow", f"h{i}.{'com' if i % 3 else 'net'}/") for i in range(0, 1500, 2)] + [("block", f"H{i}.com/p{i % 11}/") for i in range(1, 1500, 5)] + [("allow", "net/p3/")]
    table = spark.createDataFrame([*rules, ("allow", None), (None, "h2.net/")], "verdict string, rule string")
    first = {}
    for verdict, rule in rules:
        first.setdefault(rule.lower(), verdict)
    want = {}
    for i, x in enumerate(urls):
        host, _, path = (x or "").partition("://")[2].partition("/")
        labels = host.split(".")
        tails = {".".join(labels[k:]) + ("/" + path)[:n] for k in range(len(labels)) for n in range(len(path) + 2)} if host else set()
        rule = max(tails & set(first), key=len, default=None)
        want[i] = (rule, first.get(rule, "allow"))
    assert len({v for _, v in want.values()}) == 2 and {r["page_id"]: (r["rule"], r["verdict"]) for r in u.judge_urls(pages, table).collect()} == want
    ranges, given = [], u.passes
    monkeypatch.setattr(u, "passes", lambda *a: ranges.append(given(*a)) or ranges[-1])
    monkeypatch.setattr(u, "SHARD_BITS", 2000)
    monkeypatch.setattr(u, "MAX_BITS", 2500)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in u.judge_urls(pages, table).collect()} == want
    assert len(ranges[-1]) > 2 and any(len(r) > 1 for r in ranges[:-1])  # the pages, and keys while the cascades are built


def test_cuts_look_at_the_slots_that_matter():
    """The counts at a cut are those of a look at every slot; a tiny source lengthens neither pieces nor the driver's work."""
    import random

    from varguard.llm import pfair_mix as p

    def every_slot(slot, m, total):
        low = [slot * k // total for k in m]
        short, added = slot - sum(low), []
        for i in sorted((i for i, k in enumerate(m) if slot * k % total), key=lambda i: (p.due(low[i], m[i], total), i)):
            chosen = [*added, low[i] * total // m[i]]
            free = [slot - a - sum(max(n - -(-a * k // total), 0) for n, k in zip(low, m, strict=True)) for a in range(slot)]
            if len(chosen) <= short and all(sum(r >= a for r in chosen) <= f for a, f in enumerate(free)):
                added = chosen
                yield i

    rng = random.Random(5)
    for _ in range(60):
        m = p.whole_weights([rng.choice([0.001, 0.003, 0.02, 0.3, 1.0, rng.random() + 0.01]) for _ in range(rng.choice([2, 3, 6]))])
        slot, total = rng.randrange(1, 150), sum(m)
        low = [slot * k // total for k in m]
        want = list(low)
        for i in every_slot(slot, m, total):
            want[i] += 1
        assert p.counts_before(slot, m, total) == want and sum(want) == slot
    chars = [4 * 10**9, 2 * 10**9, 1]
    blocks, m = [n // 4096 + 1 for n in chars], p.whole_weights([n**0.5 for n in chars])
    planned = p.plan(blocks, m, 1000)
    assert all(x.step == 1000 for x in planned[:1]) and planned[0].length > 100 * 1000
    assert [sum(n for x in planned for i, n in zip(x.alive, x.end, strict=True) if i == k) for k in range(3)] == blocks
    seen, phase, total = [0] * 3, planned[0], sum(m)
    for start in range(0, phase.length, phase.step):
        for i, j, release, deadline, slot in p.piece(phase, m, start):
            assert j == seen[i] and release <= slot < deadline and abs(j + 1 - m[i] * (slot + 1) / total) < 1
            seen[i] += 1


def test_repeat_spans_of_a_hot_id_and_of_null_ids(spark, monkeypatch):
    """A third of the rows share an id, a third have none: they spread over the blocks, with results as by brute force."""
    from varguard.llm import repeat_spans

    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = [text(rng.randrange(13, 40)) for _ in range(12)]
    rows = []
    for i in range(180):
        parts = [text(rng.randrange(0, 30)), rng.choice(shared), text(rng.randrange(0, 30)), rng.choice(shared)]
        rows.append(({0: 7, 1: None}.get(i % 3, i), " ".join(parts)))
    rows += [(7, None), (None, ""), (7, rows[0][1]), (3, "w1 " * 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = []
    real = repeat_spans.written

    def seen(df, name):
        out = real(df, name)
        sizes.append(out.where("row_kind = 'path'").groupBy("source_id").agg(F.countDistinct("source_block")).where("source_id = 7").first()[1])
        return out

    monkeypatch.setattr(repeat_spans, "written", seen)
    got = sorted((tuple(r) for r in repeat_spans.remove_repeats(table).collect()), key=str)
    first = {}
    for i, t in rows:
        words = (t or "").split()
        for p in range(len(words) - 12):
            if i is not None:
                w = tuple(words[p : p + 13])
                first[w] = min(i, first.get(w, i))
    want = []
    for i, t in rows:
        words = (t or "").split()
        gone = {p + j for p in range(len(words) - 12) if i is not None and first[tuple(words[p : p + 13])] < i for j in range(13)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str) and sum(r[2] for r in got) > 0
    assert sizes[0] > 3  # blocks that hold sources under the hot id
