"""URL filters: a Bloom filter cascade with exact membership.

Levels alternate: level 0 encodes the listed keys, level 1 the keys of the
corpus's universe that level 0 wrongly accepts, level 2 the listed keys that
level 1 wrongly accepts, and so on until a level accepts nothing wrongly. A
key of the universe is listed exactly when the first level that refuses it is
an odd one (or none refuses and the number of levels is odd). The pages are
judged without a join: each one probes the levels with its own few keys.

Keys are dealt by hash to shards. A shard's bits are set by one task and never pass the driver bit by bit; shards that don't fit an
executor together are probed one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Bits of all levels that travel to the executors at once (128 MB), and about as many as one shard of a level has (4 MB).
#: A list with more bits is judged in several passes, each with the shards of some keys.
MAX_BITS, SHARD_BITS = 1 << 30, 1 << 25


@dataclass
class Held:
    """The levels' bits for shards ``first`` to ``last - 1`` of ``shards``: an array (shard, byte) for each level."""

    shards: int
    first: int
    last: int
    hashes: list[int]
    levels: list[np.ndarray]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys given by two 64-bit hashes each; keys of other shards are not listed here."""
        shard = shard_numbers(h2, self.shards)
        alive = np.flatnonzero((shard >= self.first) & (shard < self.last))
        listed = np.zeros(len(h1), bool)
        for level in range(len(self.levels)):
            hit = self.accepted(level, shard[alive], h1[alive], h2[alive])
            listed[alive[~hit]] = level % 2 == 1
            alive = alive[hit]
        listed[alive] = len(self.levels) % 2 == 1
        return listed

    def accepted(self, level: int, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits = self.levels[level]
        at = positions(bits.shape[1] * 8, self.hashes[level], level, h1, h2)
        byte = (at >> np.uint64(3)).astype(np.int64) + (shard - self.first) * bits.shape[1]
        return ((bits.ravel()[byte] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


@dataclass
class Cascade:
    """``levels``: tables ``(shard, bits)``, one for each level, with ``n_bytes`` a shard; each probe sets or reads ``hashes`` bits."""

    shards: int = 1
    levels: list[DataFrame] = field(default_factory=list)
    n_bytes: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)

    def held(self, first: int, last: int, levels: range | None = None) -> Held:
        """The bits of some shards, brought to the driver; those of other ``levels`` stay where they are."""
        out = []
        for level, table in enumerate(self.levels):
            wanted = levels is None or level in levels
            bits = np.zeros((last - first if wanted else 0, self.n_bytes[level]), np.uint8)
            if wanted:
                for r in table.where((F.col("shard") >= first) & (F.col("shard") < last)).collect():
                    bits[r["shard"] - first] = np.frombuffer(r["bits"], np.uint8)
            out.append(bits)
        return Held(self.shards, first, last, self.hashes, out)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys given by two 64-bit hashes each."""
        return self.held(0, self.shards).contains(h1, h2)


def passes(shards: int, shard_bytes: int) -> list[tuple[int, int]]:
    """Ranges of shards whose bits stay within ``MAX_BITS`` together."""
    each = max(1, MAX_BITS // max(1, shard_bytes * 8))
    return [(first, min(first + each, shards)) for first in range(0, shards, each)]


def shard_number(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("h2", 40), F.lit(shards)).cast("long")


def shard_numbers(h2: np.ndarray, shards: int) -> np.ndarray:
    return ((h2.astype(np.int64).view(np.uint64) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def positions(n_bits: int, k: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Bit positions of keys; each level mixes the hashes anew, so that an
    error of one level does not come back in the next but one."""
    a = h1.astype(np.uint64) + np.uint64(level + 1) * (h2.astype(np.uint64) | np.uint64(1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
        a = (a ^ (a >> np.uint64(shift))) * np.uint64(factor)
    i = np.arange(k, dtype=np.uint64)[:, None]
    return (a + i * (a >> np.uint64(17) | np.uint64(1))) % np.uint64(n_bits)


def add_level(cascade: Cascade, keys: DataFrame, n: int, rate: float) -> None:
    """One more level, over the ``n`` rows of ``keys(h1, h2)``: each shard's bits are set by one task, which holds only them."""
    level, k = len(cascade.levels), max(1, math.ceil(-math.log2(rate)))
    n_bytes = max(8, math.ceil(n / cascade.shards * k / math.log(2) / 8))

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bits = None, None
        for batch in batches:
            numbers, h1, h2 = (batch[c].to_numpy() for c in ("shard", "h1", "h2"))
            for x in np.unique(numbers).tolist():  # in order: the rows are sorted by it
                if x != shard:
                    if bits is not None:
                        yield pa.record_batch({"shard": [shard], "bits": [bits.tobytes()]})
                    shard, bits = x, np.zeros(n_bytes, np.uint8)
                at = positions(n_bytes * 8, k, level, h1[numbers == x], h2[numbers == x]).ravel()
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        if bits is not None:
            yield pa.record_batch({"shard": [shard], "bits": [bits.tobytes()]})

    dealt = keys.select(shard_number(cascade.shards).alias("shard"), "h1", "h2").repartition("shard").sortWithinPartitions("shard")
    cascade.levels.append(written(dealt.mapInArrow(to_bits, "shard long, bits binary"), "bloom"))
    cascade.n_bytes.append(n_bytes)
    cascade.hashes.append(k)


def hashed(key: str) -> list[Column]:
    """Two hash functions of a key, computed by Spark on both sides."""
    return [F.xxhash64(F.col(key)).alias("h1"), F.xxhash64(F.col(key), F.lit("url")).alias("h2")]


def build_cascade(listed: DataFrame, universe: DataFrame, shards: int | None = None) -> Cascade:
    """Cascade of ``listed(key)`` against ``universe(key)``; nulls are ignored
    and repeated keys count once. The first level's error rate is chosen so
    that about as many wrong keys pass as are listed, later levels use 1/2:
    all levels together take a few bits for each listed key, plus the log of
    the universe's size. Keys are dealt by hash to ``shards``, by default as many as keep a shard of the first level within
    ``SHARD_BITS``. Empty lists give an empty cascade (nothing listed)."""
    inside = listed.where("key is not null").select("key").distinct().select("key", *hashed("key")).checkpoint()
    n = inside.count()
    outside = universe.where("key is not null").select("key", *hashed("key"))
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, n / max(1, total))
    if shards is None:
        shards = max(1, math.ceil(n * math.ceil(-math.log2(rate or 1)) / math.log(2) / SHARD_BITS))
    cascade, keep = Cascade(shards), inside
    while n:
        add_level(cascade, keep, n, rate)
        if len(cascade.levels) == 1:
            passed = passing(outside, cascade).distinct().join(inside.select("key"), "key", "left_anti").checkpoint()
        else:
            passed = passing(other, cascade).checkpoint()
        other, keep = keep, passed
        n = passed.count()
        rate = 0.5
    return cascade


def passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """The rows of ``keys(key, h1, h2)`` that the last level accepts."""
    level, parts = len(cascade.levels) - 1, []
    for first, last in passes(cascade.shards, cascade.n_bytes[level]):
        mine = cascade.held(first, last, range(level, level + 1))

        def accept(batches: Iterator[pa.RecordBatch], held=keys.sparkSession.sparkContext.broadcast(mine)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h1, h2 = (batch[c].to_numpy() for c in ("h1", "h2"))
                shard = shard_numbers(h2, held.value.shards)
                at = np.flatnonzero((shard >= held.value.first) & (shard < held.value.last))
                yield batch.take(pa.array(at[held.value.accepted(level, shard[at], h1[at], h2[at])]))

        parts.append(keys.mapInArrow(accept, keys.schema))
    return reduce(DataFrame.union, parts)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.when(at > 0, ascii_lower(host)).otherwise(F.lit("")), F.when(at > 0, path).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``(verdict, key, labels, n)``: every rule once, its host lower-cased, its host's labels and its path's length."""
    if isinstance(rules, list):
        rules = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "nth int, verdict string, rule string")
    else:
        rules = rules.select(F.lit(0).alias("nth"), "verdict", "rule")
    host = ascii_lower(F.substring_index("rule", "/", 1))
    path = F.substring(F.col("rule"), F.length(host) + F.lit(1), F.length("rule"))
    parts = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").select("nth", "verdict", host.alias("host"), path.alias("path"))
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    keyed = parts.groupBy(F.concat("host", "path").alias("key"), labels.alias("labels"), F.length("path").alias("n"))
    return keyed.agg(F.min(F.struct("nth", "verdict"))["verdict"].alias("verdict")).select("verdict", "key", "labels", "n")


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys under which a url can be listed, longest first: for every
    number of labels and every path length that some rule has, the host's last
    labels followed by the path's first characters. A url thus has at most as
    many keys as the rules have shapes, however long it is."""
    if not shapes:
        return F.array().cast("array<string>")
    has = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    given = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(n).alias("n")) for labels, n in sorted(shapes)])
    fits = F.filter(given, lambda s: (s["labels"] <= has) & (s["n"] <= F.length(path)) & (host != ""))
    last_labels = lambda s: F.call_function("substring_index", host, F.lit("."), -s["labels"])
    found = F.array_distinct(F.transform(fits, lambda s: F.concat(last_labels(s), F.substring(path, F.lit(1), s["n"]))))
    # -length sorts the longest first; ties by the key itself
    return F.transform(F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` are ``(verdict, "host/path")``, as a list or as a table ``(verdict, rule)`` of any size. The longest key of a url that
    is listed is its rule; one cascade is built for each verdict over all keys of all pages.
    Urls under no rule get ``default``: a key that is on no list is not blocked.

    Null urls, urls without ``://`` and urls without host match no rule.
    Repeated rows are judged each; a null id stays null. An empty table gives
    an empty result. Other columns of ``pages`` are ignored. If a rule is
    listed twice its first verdict holds (of a table, the one that sorts first); rules with a null are ignored. Verdicts are few: each
    has a cascade. Cascades of more than ``MAX_BITS`` judge the pages in several passes.
    """
    spark = pages.sparkSession
    listed = rule_table(spark, rules).checkpoint()
    shapes = [tuple(r) for r in listed.select("labels", "n").distinct().collect()]
    host, path = url_parts(F.col("_url"))
    judged = (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .select("_id", host.alias("_host"), path.alias("_path"))
        .withColumn("_keys", candidate_keys(F.col("_host"), F.col("_path"), shapes))
    )
    universe = judged.select(F.explode("_keys").alias("key"))
    counts = {r["verdict"]: r["count"] for r in listed.groupBy("verdict").count().collect()}
    # some 32 bits for a listed key are enough for all levels, unless a key is one of many millions
    shards = max(1, math.ceil(32 * max(counts.values(), default=0) / SHARD_BITS))
    cascades = {v: build_cascade(listed.where(F.col("verdict") == v).select("key"), universe, shards) for v in sorted(counts)}

    def finder(first: int, last: int):
        shared = spark.sparkContext.broadcast([(v, c.held(first, last)) for v, c in cascades.items()])

        @F.pandas_udf("struct<at:int,verdict:string>")
        def first_listed(h1, h2):
            import pandas as pd

            sizes = np.array([len(x) for x in h1], np.int64)
            at = np.full(len(sizes), -1, np.int32)
            said = np.full(len(sizes), None, object)
            if sizes.sum():
                a, b = (np.concatenate([np.asarray(x, np.int64) for x in h]) for h in (h1, h2))
                rows = np.repeat(np.arange(len(sizes)), sizes)
                index = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for verdict, held in shared.value:
                    hits = np.flatnonzero(held.contains(a, b))[::-1]  # reversed: a row's first hit is written last
                    best = np.full(len(sizes), -1, np.int32)
                    best[rows[hits]] = index[hits]
                    better = (best >= 0) & ((at < 0) | (best < at))
                    at[better], said[better] = best[better], verdict
            return pd.DataFrame({"at": at, "verdict": said})

        return first_listed

    h1 = F.transform("_keys", lambda k: F.xxhash64(k))
    h2 = F.transform("_keys", lambda k: F.xxhash64(k, F.lit("url")))
    judged = judged.withColumn("_found", F.lit(None).cast("struct<at:int,verdict:string>"))
    ranges = passes(shards, sum(sum(c.n_bytes) for c in cascades.values()))
    for first, last in ranges:
        judged = judged.withColumn("_now", finder(first, last)(h1, h2))
        judged = judged.withColumn("_found", F.array_min(F.array("_found", F.when(F.col("_now.at") >= 0, F.col("_now"))))).drop("_now")
        if len(ranges) > 1:
            judged = written(judged, "judged")
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_found.at") >= 0, F.get("_keys", F.col("_found.at"))).alias("rule"),
        F.coalesce("_found.verdict", F.lit(default)).alias("verdict"),
    )
