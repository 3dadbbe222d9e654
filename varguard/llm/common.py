"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASK64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: one evaluation, cut
    lineage, and nothing to recompute when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def seed64(*parts: object) -> int:
    """A fixed 64-bit number derived from ``parts`` (same on every machine)."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def signed(x: int) -> int:
    """The same 64 bits as a Spark bigint."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the undirected ``edges(a, b)``; the component
    is its smallest node. Nodes without an edge are not listed.

    Alternates large-star and small-star steps: each node sends its larger
    neighbours, then its smaller ones, to the smallest node it knows, until
    every component is a star. Edge sets never grow, minima are combined before the
    shuffle, and each round is written to the checkpoint folder.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while True:
        # large-star: every neighbour larger than u moves to u's minimum
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        )
        # small-star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        stats = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stats(small) == stats(pairs):
            break
        pairs = small
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
