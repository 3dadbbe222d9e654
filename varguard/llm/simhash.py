"""SimHash near-dedup over pivot distance tables.

Fingerprints are compared through their Hamming distances to many reference
fingerprints (pivots). By the triangle inequality two fingerprints within d
bits differ by at most d in every such distance. One random pivot and its
variants with two neighbouring bits flipped give, as differences of
distances, coordinates that only a few bits each can change: with the 64
bits in d + 2 bands, two fingerprints within d bits agree on all coordinates of at
least two bands. So fingerprints meet in buckets keyed by the coordinates of two
bands; pairs whose distances to further random pivots differ by more than d are
discarded, and the survivors are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, seed64, signed, written

#: Random pivots whose distances travel with a fingerprint, a byte each.
FILTER_PIVOTS = 8
#: Shingles hashed at a time: bounds memory for very long texts.
STEP = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the text's ``words``-word shingles, repeats included."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + np.arange(len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        spans = zip(starts[at : min(at + STEP, n)].tolist(), last[at : min(at + STEP, n)].tolist(), strict=True)
        h = np.array([digest(flat[a:b], 42) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(id, fp)`` of every row; the 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch["text"]]
            yield pa.record_batch({"id": batch["id"], "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def with_fingerprint(docs: DataFrame, name: str, words: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``name``, the fingerprint as :func:`simhash_groups` gives it."""

    @F.pandas_udf("long")
    def fp(texts):
        import pandas as pd

        found = [fingerprint(t.encode() if isinstance(t, str) else b"", words) for t in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return docs.withColumn(name, F.lower(F.lpad(F.hex(fp(F.col(text_col).cast("string"))), 16, "0")))


def bands(max_bits: int) -> list[range]:
    cuts = [round(i * 64 / (max_bits + 2)) for i in range(max_bits + 3)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def pivot_coordinates(fp: Column, band: range) -> list[Column]:
    """Distances to the pivots of a band, relative to the distance to the
    first pivot: a pivot is that one with two neighbouring bits of the band flipped (one
    bit, in a band of one)."""
    first = seed64("pivot", 0)
    masks = [3 << i for i in band[:-1]] or [1 << band[0]]
    return [distance(fp, F.lit(signed(first ^ m))) - distance(fp, F.lit(signed(first))) for m in masks]


def pivot_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, key, far)``: a row for each two bands, with the hash of their
    coordinates as key, and the distances to the random pivots as bytes of ``far``."""
    fp = F.col("fp")
    keys = [
        F.xxhash64(F.lit(i), *pivot_coordinates(fp, a), *pivot_coordinates(fp, b)) for i, (a, b) in enumerate(combinations(bands(max_bits), 2))
    ]
    far = reduce(
        lambda x, y: x.bitwiseOR(y),
        [F.shiftleft(distance(fp, F.lit(signed(seed64("pivot", i + 1)))).cast("long"), 8 * i) for i in range(FILTER_PIVOTS)],
    )
    return fps.select("fp", far.alias("far"), F.explode(F.array(*keys)).alias("key"))


def near_pairs(fps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of the distinct ``fps(fp)`` that differ in at
    most ``max_bits`` bits. The join's condition holds the pivot test and the verification, so
    candidates never leave it, and AQE splits the buckets of frequent keys."""
    table = pivot_table(fps, max_bits)
    a = table.select(F.col("fp").alias("a"), F.col("far").alias("far_a"), "key")
    b = table.select(F.col("fp").alias("b"), F.col("far").alias("far_b"), "key")
    byte = lambda c, i: F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    close = [F.abs(byte("far_a", i) - byte("far_b", i)) <= max_bits for i in range(FILTER_PIVOTS)]
    verified = [*close, distance(F.col("a"), F.col("b")) <= max_bits]
    a_to_b = a.alias("l").join(
        b.alias("r"), reduce(lambda x, y: x & y, [F.col("l.key") == F.col("r.key"), F.col("a") < F.col("b"), *verified])
    )
    return a_to_b.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Fingerprints within ``max_bits`` bits link, and so do all rows of one
    fingerprint; ``component_id`` is the smallest id reachable. Texts without
    words (null, empty, white space) have fingerprint zero and link like any
    other. Repeated rows stay, a row with null id gets its component's smallest id (null where
    there is none). A very long text is hashed whole, a bounded number of shingles at a time; a bit set in just half of them
    is 0. An empty table gives an empty result; other columns are ignored.

    Rows of one fingerprint are one node of the search, so exact copies cost nothing in it.
    """
    if not 0 <= max_bits <= 30:
        raise ValueError("max_bits must be from 0 to 30")
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    links = near_pairs(nodes.select("fp"), max_bits)
    component = connected_components(links)
    named = nodes.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "c").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
