"""Projection, filtering, seeded ordering, splits, dense index and batches.

Splits and shuffles are hash-based (``functions.hashing``): each row decides
its side or sort key alone, so they are narrow, reproducible after a task
retry, and identical in plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FRAC_DATA_IN_SAFETY, SEED
from ..functions.hashing import hash_order_key, uniform

LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def derive_split(key, seed: int = SEED, train: float = 0.8, dev: float = 0.1) -> Column:
    """'train' / 'dev' / 'test' from a hash of the key (80 / 10 / 10 by default)."""
    u = uniform(F.lit(seed), F.lit("dataset"), _col(key))
    return F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test")


def take_split(df: DataFrame, value: str = "train", col: str = "split") -> DataFrame:
    """Keep one split; a plain filter, pushed into the scan when possible."""
    return df.filter(F.col(col) == value)


def objective_columns(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Prune to the two columns the objective reads."""
    return df.select(text, label)


def order_key(key, seed: int = SEED, salt: str = "order") -> Column:
    return hash_order_key(F.lit(seed), F.lit(salt), _col(key))


def seeded_order(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Reproducible permutation: sort by md5(seed:order:key), ties by key.

    A global sort (range partitioned): no single-partition step."""
    return df.withColumn("shuffle_key", order_key(key, seed)).orderBy("shuffle_key", key)


def seeded_head(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Sample without replacement of n rows: the first n of the seeded order.

    Planned as TakeOrderedAndProject (top-n per partition, then merged)."""
    return seeded_order(df, key, seed).limit(n)


def num_datapoints(df: DataFrame, unit_col: str | None = None) -> int:
    """Dataset size at the sampling-unit grain (a group counts once)."""
    if unit_col is None:
        return df.count()
    return df.select(unit_col).distinct().count()


def safety_part(key, frac_safety: float = FRAC_DATA_IN_SAFETY, seed: int = SEED, *extra) -> Column:
    """'safety' for a share ``frac_safety`` of the units, 'candidate' otherwise."""
    u = uniform(F.lit(seed), F.lit("split"), *extra, _col(key))
    return F.when(u < F.lit(frac_safety), "safety").otherwise("candidate")


def split_safety(df: DataFrame, key: str, frac_safety: float = FRAC_DATA_IN_SAFETY, seed: int = SEED) -> DataFrame:
    """Disjoint candidate / safety parts by hash of the unit key.

    Keyed by ``group_id`` on a long-form group table, all members of a group
    land on the same side."""
    return df.withColumn("part", safety_part(key, frac_safety, seed))


def dense_index(df: DataFrame, order_cols: Sequence, idx_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based dense row index over a total order, without a one-partition window.

    Range-partition on the order, sort inside partitions, tag rows with
    ``monotonically_increasing_id`` (partition id in the high bits, row number
    in the low 33 bits) and write the tagged rows once (reliable checkpoint in
    the shared checkpoint folder). Per-partition counts and the rows are then
    read from that one copy: two separate range shuffles would sample their
    bounds with different seeds and could disagree. The offsets table has one
    row per partition, so its broadcast is bounded by the partition count.

    ``order_cols`` should be a total order (end with a unique key) so that
    index positions are reproducible between runs.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [_col(c) for c in order_cols]
    tagged = (
        df.repartitionByRange(n, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_mid"), LOCAL_BITS))
        .checkpoint()
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return tagged.join(F.broadcast(offsets), "_pid").select(*df.columns, (F.col("_off") + local).alias(idx_col))


def assign_batches(df: DataFrame, key: str, size: int, epochs: int = 1, seed: int = SEED) -> DataFrame:
    """Mini-batch ids: each epoch is its own seeded permutation cut into
    consecutive batches of ``size`` rows. Adds ``epoch, idx, batch_id``."""
    n = df.count()
    per_epoch = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    keyed = per_epoch.withColumn("_ok", hash_order_key(F.lit(seed), F.lit("epoch"), F.col("epoch"), F.col(key)))
    indexed = dense_index(keyed, ["epoch", "_ok", key], "_g")
    idx = F.col("_g") - F.col("epoch").cast("bigint") * F.lit(n)
    return indexed.select(
        *df.columns, "epoch", idx.alias("idx"), F.floor(idx / F.lit(size)).cast("bigint").alias("batch_id")
    )
