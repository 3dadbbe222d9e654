"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so, so equal passages
give equal chunks wherever they stand. A document becomes its recipe: the
ordered list of its chunks' identifiers. Identifiers are verified: chunk
contents travel once, combined before the shuffle, and no identifier may
stand for two contents. Equal recipes then mean equal texts, and from there
on only recipes move, never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import seed64, written

#: Cuts fall at hashes with these many low zero bits (mean chunk about 2 KB)...
CUT_BITS = 11
#: ... with chunks of this many bytes at least and at most.
MIN_CHUNK, MAX_CHUNK = 256, 16384
WINDOW = 32
GEAR = np.array([seed64("gear", i) & 0xFFFFFFFF for i in range(256)], np.uint32)
#: Identifier bytes; doubled (up to 64) if two contents ever share one.
ID_BYTES = 16


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last one is its length."""
    if len(data) <= MIN_CHUNK:
        return [len(data)] if data else []
    rolling = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # the hash of 2n bytes from two of n bytes
        wider = rolling.copy()
        wider[span:] += rolling[:-span] << np.uint32(span)
        rolling, span = wider, 2 * span
    cuts, start = [], 0
    for end in (np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            cuts.append(start)
        if end - start >= MIN_CHUNK:
            cuts.append(end)
            start = end
    while len(data) - start > MAX_CHUNK:
        start += MAX_CHUNK
        cuts.append(start)
    if start < len(data):
        cuts.append(len(data))
    return cuts


def chunk_ids(data: bytes, id_bytes: int) -> tuple[list[bytes], list[bytes]]:
    ends = cut_points(data)
    chunks = [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
    return [hashlib.blake2b(c, digest_size=64).digest()[:id_bytes] for c in chunks], chunks


def recipes(texts: DataFrame, id_bytes: int) -> DataFrame:
    """``(doc_id, text_sha256, recipe)`` of ``texts(doc_id, text_sha256, norm)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b"".join(chunk_ids(x.as_buffer().to_pybytes(), id_bytes)[0]) for x in batch["norm"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "text_sha256": batch["text_sha256"], "recipe": pa.array(made, pa.binary())})

    return texts.mapInArrow(run, "doc_id long, text_sha256 string, recipe binary")


def chunk_table(texts: DataFrame, id_bytes: int) -> DataFrame:
    """``(id, chunk)`` of every text; a batch lists a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[bytes, bytes]] = set()
            for x in batch["norm"]:
                found.update(zip(*chunk_ids(x.as_buffer().to_pybytes(), id_bytes), strict=True))
            yield pa.record_batch({"id": pa.array([i for i, _ in found], pa.binary()), "chunk": pa.array([c for _, c in found], pa.binary())})

    return texts.select("norm").mapInArrow(run, "id binary, chunk binary")


def colliding(texts: DataFrame, id_bytes: int) -> int:
    """How many identifiers stand for more than one content."""
    contents = chunk_table(texts, id_bytes).distinct()
    return contents.groupBy("id").count().where("count > 1").count()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = ID_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs``.

    Texts are equal when identical after white space is normalised; null
    counts as empty and empty texts equal each other. Of equal texts the
    smallest id stays; rows that repeat that id are all marked kept, null ids never
    (their keep_id is null where the whole group has none). An empty table
    gives an empty result; other columns are ignored.

    A very long text is cut into chunks within its row; only chunks and their identifiers are shuffled.

    If two contents ever share an identifier, it is widened and everything is done again, so the
    result never rests on a hash alone.
    """
    norm = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), "norm"
    )
    while colliding(texts, id_bytes):
        if id_bytes >= 64:
            raise ValueError("two chunks share a 64-byte identifier")
        id_bytes = min(64, 2 * id_bytes)
    made = written(recipes(texts, id_bytes), "recipes")
    # checkpointed, so that the join has plain shuffles on both sides, and AQE splits a recipe with very many documents
    groups = made.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).checkpoint()
    return made.join(groups, "recipe").select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )
