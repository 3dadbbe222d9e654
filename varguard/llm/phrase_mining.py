"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are packed into chunks of one language. Prefix polynomials (NumPy, modulo 2^64) hash every
word and every n-gram of a chunk. The shuffle sums fingerprints, each with a pointer to the chunk
it occurs in, and those that reach the threshold go back along their pointers. There
the chunk's words tell whether occurrences of a fingerprint are the same phrase, and
only such frequent phrases become text, which is counted exactly: sorted and compressed, a row for each chunk and range. Phrases of three and four words are looked
for only where all their word pairs are frequent.

Fingerprints only choose what is counted: phrases that collide raise each other's sums, never lower
them, and are told apart by their words in the chunk and by their text across chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import seed64, written

#: Bytes of text in a chunk, and of fingerprints that one task sums at a time.
CHUNK_BYTES, RANGE_BYTES = 4 << 20, 32 << 20
#: Phrases of a range that are held before their counts are summed.
HELD_PHRASES = 1 << 19
#: A-Z lower-cased; tabs become blanks, the ends of pieces newlines.
NORMAL = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bases of the polynomials over bytes and over words: odd, so they have an inverse modulo 2^64.
BYTE_BASE, WORD_BASE = seed64("byte") | 1, seed64("word") | 1
MIX = np.uint64(0x9E3779B97F4A7C15)

CHUNK_SCHEMA = "lang string, n_words long, text binary"
ENTRY_SCHEMA = "range int, chunk long, keys binary, counts binary"


def chunks_of(docs: DataFrame, lang_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """``(lang, n_words, text)``: the texts of a language one after the other, normalised and compressed. Only
    a piece longer than a chunk makes a longer one: no phrase crosses the end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            text = b"\n".join(held.pop(lang))
            sizes.pop(lang)
            rows = {"lang": [lang], "n_words": [len(text.translate(WORDS_ONLY).split())], "text": [pack(text)]}
            return pa.record_batch(rows, schema=pa.schema([("lang", pa.string()), ("n_words", pa.int64()), ("text", pa.binary())]))

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                normal = text.as_buffer().to_pybytes().translate(NORMAL) if text.is_valid else b""
                for part in parts(normal, chunk_bytes):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= chunk_bytes:
                        yield out(lang)
            while sum(sizes.values()) > 4 * chunk_bytes:  # many languages
                yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, CHUNK_SCHEMA)


#: Words end at blanks and newlines only: other ASCII white space is part of a word.
WORDS_ONLY = bytes(120 if b not in (10, 32) else b for b in range(256))


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` cut at ends of pieces into parts of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    if len(text) > at:
        yield text[at:]


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """Sorted numbers byte by byte, the highest first: those are nearly constant and compress."""
    return values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind).newbyteorder(">")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel().astype(kind.newbyteorder("="))


def packed(keys: np.ndarray) -> bytes:
    """Sorted numbers as their differences, which need the fewer bits the closer they lie."""
    return pack(planes(np.diff(keys, prepend=keys.dtype.type(0))))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(unpack(data), np.uint64), dtype=np.uint64)


def gram_bits(words: int) -> int:
    """Bits of a fingerprint: 256 times as many values as words, so few share one. Those that do only cost work."""
    return min(64, words.bit_length() + 8)


@lru_cache(maxsize=2)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64. A worker keeps those for bytes and for words."""
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        row = np.full(size, x, np.uint64)
        row[0] = 1
        both.append(np.multiply.accumulate(row))
    return both[0], both[1]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * MIX
    x ^= x >> np.uint64(32)
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` for each pair, from one prefix sum."""
    size = (len(values) // (1 << 19) + 1) << 19  # few sizes: most chunks are equally long
    up, down = powers(base, size)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, up[: len(values)], out=prefix[1:])
    np.cumsum(prefix[1:], out=prefix[1:])
    return (prefix[end] - prefix[start]) * down[start]  # differences of sums wrap as the sums do


class Chunk:
    """The words of a chunk's text, their places and hashes."""

    def __init__(self, lang: str, text: bytes, bits: int = 64):
        self.lang, self.text, self.bits = lang, text, bits
        self.bytes = np.frombuffer(text, np.uint8)
        gap = np.ones(len(self.bytes) + 2, bool)
        gap[1:-1] = (self.bytes == 32) | (self.bytes == 10)
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.end = np.flatnonzero(~gap[:-1] & gap[1:])
        self.piece = np.searchsorted(np.flatnonzero(self.bytes == 10), self.start)
        random = np.random.default_rng(seed64("bytes")).integers(0, 1 << 64, 256, np.uint64)
        self.word = mixed(spans(random[self.bytes], self.start, self.end, BYTE_BASE), 0) if len(self.start) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams within pieces, and their fingerprints."""
        at = np.arange(max(0, len(self.start) - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        return at, mixed(spans(self.word, at, at + n, WORD_BASE), seed64(self.lang, n)) >> np.uint64(64 - self.bits)

    def word_ids(self) -> np.ndarray:
        """Equal numbers for equal words: those of one hash are compared byte by byte."""
        _, first, ids = np.unique(self.word, return_index=True, return_inverse=True)
        like, size = first[ids], self.end - self.start
        same = size == size[like]
        odd = np.zeros(len(ids), bool)
        at = np.flatnonzero(same & (like != np.arange(len(ids))))
        for lo in range(0, len(at), 1 << 18):
            some = at[lo : lo + (1 << 18)]
            offset = np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            differ = self.bytes[np.repeat(self.start[some], size[some]) + offset] != self.bytes[np.repeat(self.start[like[some]], size[some]) + offset]
            odd[np.repeat(some, size[some])[differ]] = True
        ids = ids.astype(np.int64)
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(odd | ~same).tolist():
            ids[i] = len(self.start) + names.setdefault(self.text[self.start[i] : self.end[i]], len(names))
        return ids

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join([self.text[s:e] for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)])

    def frequent(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams whose fingerprint is in ``keys`` (sorted)."""
        at, fp = self.grams(n)
        if not len(keys):
            return at[:0], fp[:0]
        found = keys[np.minimum(np.searchsorted(keys, fp), len(keys) - 1)] == fp
        return at[found], fp[found]

    def phrases(self, n: int, at: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> list[tuple[bytes, int]]:
        """Phrases and counts: occurrences of a fingerprint are one phrase if all their words are equal."""
        _, first, group, count = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        odd = np.zeros(len(at), bool)
        for k in range(n):
            odd |= ids[at + k] != ids[at[first[group]] + k]
        count -= np.bincount(group[odd], minlength=len(count))
        out = [(self.phrase(a, n), c) for a, c in zip(at[first].tolist(), count.tolist(), strict=True)]
        return out + [(self.phrase(a, n), 1) for a in at[odd].tolist()]


def cuts(at: np.ndarray) -> list[tuple[int, int]]:
    """Where each of the sorted ranges begins and ends."""
    cut = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def entries(chunk_id: int, fps: list[np.ndarray], bits: int, ranges: int) -> pa.RecordBatch:
    """Distinct fingerprints of a chunk and their counts, a row for each range of fingerprints."""
    keys, counts = np.unique(np.concatenate(fps), return_counts=True)
    at = ((keys << np.uint64(64 - bits) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    both = cuts(at)
    return pa.record_batch(
        {
            "range": pa.array([at[i] for i, _ in both], pa.int32()),
            "chunk": pa.array([chunk_id] * len(both), pa.int64()),
            "keys": pa.array([packed(keys[i:j]) for i, j in both], pa.binary()),
            "counts": pa.array([pack(planes(counts[i:j].astype(np.uint32))) for i, j in both], pa.binary()),
        }
    )


def phrase_entries(lang: str, found: list[tuple[bytes, int]], ranges: int) -> pa.RecordBatch:
    """Phrases of a chunk and their counts, a row for each range of the phrases' CRC: sorted, a line each, compressed."""
    at = [zlib.crc32(p) * ranges >> 32 for p, _ in found]
    rows = pa.table({"range": pa.array(at, pa.int32()), "phrase": pa.array([p for p, _ in found], pa.binary()), "count": pa.array([c for _, c in found], pa.uint32())})
    rows = rows.sort_by([("range", "ascending"), ("phrase", "ascending")])
    at, phrases, counts = rows["range"].to_numpy(), rows["phrase"].to_pylist(), rows["count"].to_numpy()
    both = cuts(at)
    return pa.record_batch(
        {
            "lang": pa.array([lang] * len(both), pa.string()),
            "range": pa.array([at[i] for i, _ in both], pa.int32()),
            "phrases": pa.array([pack(b"\n".join(phrases[i:j])) for i, j in both], pa.binary()),
            "counts": pa.array([pack(planes(counts[i:j])) for i, j in both], pa.binary()),
        }
    )


def frequent_phrases(rows: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, f)``: the phrases that occur ``least`` times or more in all chunks, by their text."""

    def run(table: pa.Table) -> pa.Table:
        sums = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.binary()), "count": pa.array([], pa.int64())})
        held, size = [sums], 0
        for i, row in enumerate(table.to_pylist(), 1):
            phrases, counts = unpack(row["phrases"]).split(b"\n"), from_planes(unpack(row["counts"]), np.uint32)
            held.append(pa.table({"lang": pa.array([row["lang"]] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.binary()), "count": pa.array(counts, pa.int64())}))
            size += len(phrases)
            if size > HELD_PHRASES or i == table.num_rows:
                sums = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("count", "sum")])
                sums = sums.select(["lang", "phrase", "count_sum"]).rename_columns(["lang", "phrase", "count"])
                held, size = [sums], 0
        return sums.filter(pc.field("count") >= least).rename_columns(["lang", "phrase", "f"])

    return rows.groupBy("range").applyInArrow(run, "lang string, phrase binary, f long")


def frequent_keys(rows: DataFrame, least: int) -> DataFrame:
    """``(chunk, keys)``: the fingerprints of each chunk that occur ``least`` times or more in all chunks."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpacked(x) for x in table["keys"].to_pylist()]
        counts = [from_planes(unpack(x), np.uint32) for x in table["counts"].to_pylist()]
        each, which = np.unique(np.concatenate(keys), return_inverse=True)
        many = np.bincount(which, weights=np.concatenate(counts), minlength=len(each)) >= least  # sums below 2^53 are exact
        ends = np.cumsum([len(k) for k in keys])
        kept = [k[m] for k, m in zip(keys, np.split(many[which], ends[:-1]), strict=True)]
        some = [i for i, k in enumerate(kept) if len(k)]
        return pa.table({"chunk": table["chunk"].take(pa.array(some, pa.int64())), "keys": pa.array([packed(kept[i]) for i in some], pa.binary())})

    return rows.groupBy("range").applyInArrow(run, "chunk long, keys binary")


FOUND_SCHEMA = "lang string, range int, phrases binary, chunk long, keys binary, counts binary"
FOUND = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("phrases", pa.binary()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def at_chunks(chunks: DataFrame, keys: DataFrame, lengths: tuple, longer: tuple, bits: int, ranges: int) -> DataFrame:
    """Along the pointers: the frequent phrases of ``lengths`` words with their counts in each chunk, and
    fingerprints of the ``longer`` ones whose word pairs are all frequent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        chunk = Chunk(left["lang"][0].as_py(), unpack(left["text"][0].as_py()), bits)
        wanted = np.sort(np.concatenate([unpacked(x) for x in right["keys"].to_pylist()]))
        ids, found = chunk.word_ids(), []
        for n in lengths:
            found += chunk.phrases(n, *chunk.frequent(n, wanted), ids)
        out = [phrase_entries(chunk.lang, found, ranges)]
        if longer:
            pair = np.zeros(len(chunk.start) + max(longer), bool)
            pair[chunk.frequent(2, wanted)[0]] = True
            fps = []
            for n in longer:
                at, fp = chunk.grams(n)
                fps.append(fp[np.all([pair[at + k] for k in range(n - 1)], axis=0)])
            out.append(entries(left["chunk"][0].as_py(), fps, bits, ranges))
        whole = pa.concat_tables([pa.Table.from_batches([x]) for x in out], promote_options="default")
        return pa.table({f.name: whole[f.name] if f.name in whole.column_names else pa.nulls(whole.num_rows, f.type) for f in FOUND}, schema=FOUND)

    return chunks.select("chunk", "lang", "text").groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(run, FOUND_SCHEMA)


def phrase_counts(docs: DataFrame, least: int, most_words: int, lang_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, n, phrase, f)`` of all phrases of up to ``most_words`` words with f >= ``least``, and ``(lang, n_words)``."""
    chunks = written(chunks_of(docs, lang_col, text_col, chunk_bytes).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    bits = gram_bits(words)
    # bytes of two fingerprints with counts for each word
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words * 24 // RANGE_BYTES))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["lang"], unpack(row["text"]), bits)
                yield entries(row["chunk"], [chunk.grams(n)[1] for n in (1, 2)], bits, ranges)

    keys = frequent_keys(chunks.select("chunk", "lang", "text").mapInArrow(short, ENTRY_SCHEMA), least)
    longer = tuple(range(3, most_words + 1))
    found = written(at_chunks(chunks, keys, (1, 2), longer, bits, ranges), "phrases")
    columns = ["lang", "range", "phrases", "counts"]
    texts = found.where("phrases IS NOT NULL").select(columns)
    if longer:
        keys = frequent_keys(found.where("keys IS NOT NULL").select("range", "chunk", "keys", "counts"), least)
        texts = texts.union(at_chunks(chunks, keys, longer, (), bits, ranges).select(columns))
    phrase = F.col("phrase").cast("string")
    exact = frequent_phrases(texts, least).select("lang", F.size(F.split(phrase, " ")).alias("n"), phrase.alias("phrase"), "f")
    exact = written(exact, "counts")
    return exact, chunks.groupBy("lang").agg(F.sum("n_words").alias("n_words"))


def collocations(
    docs: DataFrame,
    least: int = 30,
    most_words: int = 4,
    top: int = 2000,
    percent: int = 80,
    lang_col: str = "lang",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``most_words`` words.

    A phrase occurs a >= ``least`` times; its score is the lowest of floor(2000000 a / (l + r)) over the ways to cut it in
    two (l, r: how often its parts occur; of equal cuts the first). Phrases inside a longer one that occurs
    ``percent`` % as often are dropped. Order: score and a descending, then the phrase's UTF-8 bytes.
    Null and empty texts hold no words, a null language is ``und``. A language without phrases, like an empty
    table, has no rows. Very long texts are cut at ends of pieces. Repeated rows count each; other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, most_words, lang_col, text_col, chunk_bytes)
    words = F.split("phrase", " ")
    long = counts.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), words.alias("w"))
    cut = long.select("lang", "phrase", "n", "a", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("tail"),
    )
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # a whole decimal quotient: 2000000 a may pass 64 bits, the score is at most 1000000
    score = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    cuts = cut.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = long.where("n > 2").select("lang", "n", "w", "a", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    inner = inner.select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    inside = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * percent)
    )
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    leading = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return leading.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", F.col("n_words").alias("n"), "best.score"
    )
