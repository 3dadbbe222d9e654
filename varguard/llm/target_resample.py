"""Importance resampling towards a target distribution.

Documents are scored with arrays: hashed word and word-pair features, one gain per
bucket from the counts of the raw and the target corpus, a document's weight the
floored mean of its features' gains, plus Gumbel noise drawn from its id. The highest
scores are drawn. Ranks come from parallel sorting by regular sampling: every task sorts
a run, regular samples of all runs give the splitters, segments are exchanged and merged
in their range, and prefix sums of the ranges' sizes make positions exact ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 10_000
#: Regular samples taken for each range of ranks.
SAMPLES = 16
#: Words are runs of digits, letters and non-ASCII characters; A-Z is lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Order of ranks; ``place`` (a stored row number) makes equal rows distinct.
KEYS = ["down", "no_id", "id", "n_features", "place"]


def bucket_ids(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of the text's words, then of its pairs of neighbouring words."""
    words = text.translate(WORD_BYTES).split()
    single = [zlib.crc32(w) for w in words]
    pairs = [zlib.crc32(b" " + w, c) for c, w in zip(single, words[1:])]
    return np.array(single + pairs, np.int64) % buckets


def texts_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch["text"]:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all ``texts``; tasks sum their own texts first, and
    ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in texts_of(batch):
                held.append(bucket_ids(text, buckets))
                size += len(held[-1])
                if size > 1 << 18:
                    seen += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=buckets)
        used = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": pa.array(used.astype(np.int64)), "n": pa.array(seen[used])})

    total = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of each bucket's log ratio, both corpora smoothed by one."""
    all_raw, all_target, buckets = float(raw.sum()), float(target.sum()), len(raw)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_raw + buckets) / ((s + 1.0) * (all_target + buckets))))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in floored thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_rows(docs: DataFrame, gain: np.ndarray, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of each document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for text in texts_of(batch):
                at = bucket_ids(text, buckets)
                n.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            features, weights = np.array(n, np.int64), np.array(weight, np.int64)
            drawn = np.array([noise(i, seed) for i in batch["id"].to_pylist()], np.int64)
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "n_words": pa.array((features + 1) // 2),
                    "n_features": pa.array(features),
                    "weight": pa.array(weights),
                    "score": pa.array(weights + drawn),
                }
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def as_keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[k].fill_null(0).to_numpy().astype(np.int64) for k in KEYS])


def regular_samples(runs: DataFrame, step: int) -> list[tuple]:
    """The keys of every ``step``-th row of each sorted run, sorted. A run begins at
    another place than the last, so that short ones are met as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = TaskContext.get().partitionId() * 0x9E3779B1 % step
        for batch in batches:
            at = np.arange(wait, batch.num_rows, step)
            wait += len(at) * step - batch.num_rows
            yield pa.record_batch([pa.array(k[at]) for k in as_keys(batch)], names=KEYS)

    return sorted(map(tuple, runs.mapInArrow(run, ", ".join(f"{k} long" for k in KEYS)).collect()))


def with_range(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``rows`` with the number of splitters that stand at or before them."""
    cuts = np.array(splitters, np.int64).reshape(-1, len(KEYS)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.concatenate([cuts, as_keys(batch)], axis=1)
            order = np.lexsort(both[::-1])  # stable: of equal keys the splitter is first
            before = np.empty(len(order), np.int32)
            before[order] = np.cumsum(order < cuts.shape[1])
            yield pa.record_batch(
                [batch[c] for c in batch.schema.names] + [pa.array(before[cuts.shape[1] :])], names=[*batch.schema.names, "range"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, range int")


def numbered(merged: DataFrame) -> DataFrame:
    """``merged``, sorted by range and key in each partition, with ``pos``: a row's place in its range, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["range"].to_numpy()
            begins = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            pos = np.arange(len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part)))) + 1
            if part[0] == last:
                pos[part == last] += n
            last, n = int(part[-1]), int(pos[-1])
            yield pa.record_batch([batch[c] for c in batch.schema.names] + [pa.array(pos.astype(np.int64))], names=[*batch.schema.names, "pos"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in merged.schema.fields)
    return merged.mapInArrow(run, f"{fields}, pos long")


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with ``rank``, 1 for the least key, by regular sampling."""
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    samples = regular_samples(rows.sortWithinPartitions(*KEYS), max(1, n // (ranges * SAMPLES)))
    splitters = [samples[len(samples) * i // ranges] for i in range(1, ranges)] if samples else []
    segments = with_range(rows, splitters).repartitionById(ranges, F.col("range"))
    merged = written(numbered(segments.sortWithinPartitions("range", *KEYS)), "ranks")
    sizes = sorted(map(tuple, merged.groupBy("range").agg(F.max("pos")).collect()))  # a row for each range
    starts, before = [], 0
    for r, size in sizes:
        starts.append((r, before))
        before += size
    offsets = spark.createDataFrame(starts, "range int, before long")
    return merged.join(F.broadcast(offsets), "range").withColumn("rank", F.col("before") + F.col("pos"))


def resample_to_target(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    seed: int = 7,
    min_words: int = 20,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row of ``docs``.

    Of the N documents with ``min_words`` words or more the ``percent * N // 100`` highest scores are
    drawn and ranked from 1, ties to the smaller id (null ids last, then fewer features; rows equal
    in all of that in either order); all others have no rank. Null and empty texts have no features and
    weight 0; a null id's noise is that of an empty id; rows that share an id are judged
    each by its text. An empty table gives an empty result, an empty target draws by the
    smoothed counts alone. Very long texts are scored whole. Other columns are ignored.
    """
    gain = gains(
        bucket_counts(docs.select(F.col(text_col).alias("text")), buckets), bucket_counts(target.select(F.col(text_col).alias("text")), buckets)
    )
    scored = scored_rows(docs, gain, seed, id_col, text_col)
    scored = written(scored.withColumn("place", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= min_words
    n = scored.where(fit).count()
    keyed = scored.where(fit).withColumns({"down": -F.col("score"), "no_id": F.col("id").isNull().cast("long")})
    drawn = ranked(keyed, n).withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    cols = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return drawn.select(*cols, "rank").union(scored.where(~fit).select(*cols, F.lit(None).cast("long").alias("rank")))
