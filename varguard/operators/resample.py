"""Resampling and the experiment grid.

* ``bootstrap``: exact draws with replacement (n draws per trial), by hashing
  (trial, draw) to a dense row index and joining on it. The small-data check.
* ``bootstrap_weights``: Poisson(1) weight per (unit, trial) from a hash — the
  scalable bootstrap: no index, no join, no data copies; the weights feed
  weighted sums.
* ``min_frac_id``: nested data fractions. A unit's hash u puts it in every
  fraction f_k > u, so the subsets grow with f and one aggregation by
  (smallest k) plus a running sum gives all fractions at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEED, frac_grid_values
from ..functions.hashing import hash60, uniform
from .prep import dense_index


def poisson_cdf(lam: float = 1.0, tail: float = 2.0 ** -33) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until 1 - P < tail (below the hash resolution)."""
    out, term, total, k = [], math.exp(-lam), 0.0, 0
    while True:
        total += term
        out.append(total)
        if 1.0 - total < tail:
            return out
        k += 1
        term *= lam / k


def _steps_sql(u: str, steps, last: int) -> Column:
    """``CASE WHEN u < s0 THEN 0 WHEN u < s1 THEN 1 ... ELSE last END`` over a
    column named ``u``, built from SQL text (one JVM call)."""
    body = " ".join(f"WHEN `{u}` < {float(s)!r}D THEN {k}" for k, s in enumerate(steps))
    return F.expr(f"CASE {body} ELSE {last} END")


def poisson_weight(u, lam: float = 1.0) -> Column:
    """Inverse-CDF Poisson draw from a uniform: the number of CDF steps <= u.
    ``u`` is a Column or the name of a column (faster to plan)."""
    cdf = poisson_cdf(lam)
    if isinstance(u, str):
        return _steps_sql(u, cdf, len(cdf))
    expr = F.when(u < F.lit(cdf[0]), F.lit(0))
    for k, c in enumerate(cdf[1:], start=1):
        expr = expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(cdf)))


def bootstrap_weights(df: DataFrame, key: str, trials: int, seed: int = SEED, salt: str = "boot") -> DataFrame:
    """Adds ``trial_i`` (0..trials-1) and Poisson(1) weight ``w`` per unit.

    Exploding trials is a narrow step; every copy of a unit is one weighted
    row, so a unit drawn 5 times costs one row, not five."""
    t = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial_i")
    with_t = df.select("*", t)
    return with_t.withColumn("w", poisson_weight(uniform(F.lit(seed), F.lit(salt), F.col("trial_i"), F.col(key))))


def bootstrap(df: DataFrame, key: str, trials: int, n: int | None = None, seed: int = SEED) -> DataFrame:
    """Exact bootstrap: ``trials`` x ``n`` draws with replacement.

    Draw (t, d) picks dense index hash60(seed:draw:t:d) mod N. Rows:
    ``(trial_i, draw, <df columns>)``. The draws table grows with the data
    (trials x n rows) and meets the indexed rows in an equi-join on the index."""
    spark = df.sparkSession
    total = df.count()
    n = total if n is None else n
    if total == 0 or n == 0:
        return df.select(F.lit(0).alias("trial_i"), F.lit(0).cast("bigint").alias("draw"), "*").limit(0)
    indexed = dense_index(df, [key], "_idx")
    draws = spark.range(trials * n).select(
        (F.col("id") / F.lit(n)).cast("int").alias("trial_i"), (F.col("id") % F.lit(n)).alias("draw")
    )
    draws = draws.withColumn("_idx", hash60(F.lit(seed), F.lit("draw"), F.col("trial_i"), F.col("draw")) % F.lit(total))
    return draws.join(indexed, "_idx").drop("_idx")


def min_frac_id(u, fracs: Sequence[float]) -> Column:
    """Smallest k with u < fracs[k] (fracs ascending, last = 1.0). ``u`` is a
    Column or the name of a column."""
    if isinstance(u, str):
        return _steps_sql(u, list(fracs), len(fracs) - 1)
    expr = F.when(u < F.lit(fracs[0]), F.lit(0))
    for k, f in enumerate(fracs[1:], start=1):
        expr = expr.when(u < F.lit(f), F.lit(k))
    return expr.otherwise(F.lit(len(fracs) - 1))


def frac_ids(df: DataFrame, key: str, trial_col: str = "trial_i", fracs: Sequence[float] | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``min_frac_id``: the unit belongs to fraction k of its trial iff
    min_frac_id <= k."""
    fracs = list(fracs or frac_grid_values())
    return df.withColumn("min_frac_id", min_frac_id(uniform(F.lit(seed), F.lit("frac"), F.col(trial_col), F.col(key)), fracs))


def take_frac(df: DataFrame, frac_id: int) -> DataFrame:
    return df.filter(F.col("min_frac_id") <= frac_id)


def frac_grid(base: DataFrame, fracs: Sequence[float] | None = None) -> DataFrame:
    """``(frac_id, data_frac)`` attached to each row of ``base`` (a literal array
    exploded in place: no join)."""
    fracs = list(fracs or frac_grid_values())
    arr = F.array(*[F.lit(float(f)) for f in fracs])
    return base.select("*", F.posexplode(arr).alias("frac_id", "data_frac"))


def trial_grid(base: DataFrame, trials: int, fracs: Sequence[float] | None = None) -> DataFrame:
    """Every (frac_id, trial_i) cell for each row of ``base``."""
    return frac_grid(base, fracs).select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial_i"))


def pending_trials(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Grid cells without a recorded result (anti join on the integer keys)."""
    return grid.join(done.select("frac_id", "trial_i").distinct(), ["frac_id", "trial_i"], "left_anti")


def unit_grid(spark: SparkSession) -> DataFrame:
    """A one-row frame to hang literal grids on."""
    return spark.range(1).select()
