"""Aggregate measures: objective, group variance, performance, summaries.

All are algebraic aggregates, so Spark combines them map-side before the
shuffle; a group holding a third of all rows costs one partial row per map
task, not one task holding the group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_loss, sigmoid


@dataclass(frozen=True)
class Metric:
    """A performance function over labelled rows: ``terms(label, probability)`` are its row values, ``finish`` turns
    their means into the metric. Sums of terms merge in any order, so a metric is resampled, cut and
    combined map-side like a mean."""

    name: str
    terms: Callable[[Column, Column], list[Column]]
    finish: Callable[[list[Column]], Column]


_METRICS: dict[str, Metric] = {}


def register_metric(name: str, terms: Callable[[Column, Column], list[Column]], finish: Callable[[list[Column]], Column] = lambda means: means[0]) -> None:
    """Bind a performance or objective function to a name that an experiment's configuration can give."""
    _METRICS[name] = Metric(name, terms, finish)


def metric(name: str) -> Metric:
    if name not in _METRICS:
        raise KeyError(f"unknown metric {name!r}; registered: {sorted(_METRICS)}")
    return _METRICS[name]


def _balanced_terms(y: Column, p: Column) -> list[Column]:
    y, yes = y.cast("double"), (p >= 0.5).cast("double")
    return [y * yes, y, (1 - y) * (1 - yes), 1 - y]


register_metric("log_loss", lambda y, p: [log_loss(y, p)])
register_metric("brier", lambda y, p: [(p - y.cast("double")) * (p - y.cast("double"))])
# mean of the shares of positive and of negative rows that are told right; NULL where either is absent
register_metric(
    "balanced_accuracy",
    _balanced_terms,
    lambda m: (F.when(m[1] > 0, m[0] / m[1]) + F.when(m[3] > 0, m[2] / m[3])) / 2,
)


def cross_entropy(scored: DataFrame, label_col: str = "label", logit_col: str = "logit", by=("candidate_id",)) -> DataFrame:
    """Mean clipped log loss from logits: ``(by..., n_rows, loss)``."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(log_loss(label_col, sigmoid(F.col(logit_col)))).alias("loss"),
    )


def perf_eval(df: DataFrame, label_col: str = "label", prob_col: str = "prob", by=("candidate_id",)) -> DataFrame:
    """Mean clipped log loss from given probabilities (no sigmoid):
    ``(by..., n_rows, performance)``. Probabilities outside [0, 1] raise."""
    p = F.col(prob_col)
    checked = F.when(p.between(0.0, 1.0), p).otherwise(
        F.raise_error(F.concat(F.lit("probability outside [0, 1]: "), p.cast("string")))
    )
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(log_loss(label_col, checked)).alias("performance"),
    )


def vprob(members: DataFrame, group_col: str = "group_id", logit_col: str = "logit", by=("candidate_id",)) -> DataFrame:
    """Measure VPROB per group: sample variance of the member probabilities.

    ``(by..., group_id, n_members, vprob)``; vprob is NULL for a one-member
    group (sample variance undefined). Spark's var_samp merges partial
    moments (no sum-of-squares cancellation).
    """
    return members.groupBy(*by, group_col).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.var_samp(sigmoid(F.col(logit_col))).alias("vprob"),
    )


def vrange(members: DataFrame, group_col: str = "group_id", logit_col: str = "logit", by=("candidate_id",)) -> DataFrame:
    """A second group measure: max - min of member probabilities."""
    p = sigmoid(F.col(logit_col))
    return members.groupBy(*by, group_col).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.when(F.count(F.lit(1)) >= 2, F.max(p) - F.min(p)).alias("vrange"),
    )


def summarise(df: DataFrame, value_col: str, by=("candidate_id",)) -> DataFrame:
    """Summary of a per-unit measure: ``(by..., n, n_dropped, mean, sd)``.

    NULL values (undefined measure, e.g. one-member groups) are dropped and
    counted in ``n_dropped``.
    """
    v = F.col(value_col)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("bigint").alias("n_dropped"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
    )


def summarise_batched(df: DataFrame, value_col: str, batch_col: str, by=("candidate_id",)) -> DataFrame:
    """:func:`summarise` computed from per-batch moments ``(n_b, mean_b, M2_b)``
    merged with the parallel-variance rule; equals the unbatched summary."""
    v = F.col(value_col)
    per_batch = df.groupBy(*by, batch_col).agg(
        F.count(v).alias("n_b"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("bigint").alias("d_b"),
        F.avg(v).alias("mean_b"),
        (F.coalesce(F.var_samp(v), F.lit(0.0)) * (F.count(v) - 1)).alias("m2_b"),
    )
    merged = per_batch.groupBy(*by).agg(
        F.sum("n_b").alias("n"),
        F.sum("d_b").alias("n_dropped"),
        (F.sum(F.col("n_b") * F.col("mean_b")) / F.sum("n_b")).alias("mean"),
    )
    spread = per_batch.join(merged.select(*by, F.col("mean").alias("_m")), list(by)).groupBy(*by).agg(
        (F.sum("m2_b") + F.sum(F.when(F.col("n_b") > 0, F.col("n_b") * (F.col("mean_b") - F.col("_m")) ** 2).otherwise(0.0))).alias(
            "m2"
        )
    )
    return merged.join(spread, list(by)).select(
        *by,
        "n",
        "n_dropped",
        "mean",
        F.when(F.col("n") >= 2, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n") - 1))).alias("sd"),
    )
