"""Slice 1: one constrained evaluation of a set of scorers.

"Is each scorer's mean within-group variance <= 0.05 with 95 % confidence,
and what does it cost in loss?" One plan: the labelled table and the group
table are scored in place (no shuffle), the loss and the per-group variance
are combined map-side, and the per-model summary rows meet in a join of K
rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import VPROB, Constraint
from ..functions.scalar import round6
from ..operators.constraints import group_measures, passes, t_upper_bound
from ..operators.measures import cross_entropy
from ..operators.score import score_terms


def scored_rows(primary: DataFrame, weights: DataFrame) -> DataFrame:
    """``(doc_id, label, candidate_id, logit)``: ``primary`` is either already
    scored (has ``logit``) or raw labelled text (has ``text``)."""
    if "logit" in primary.columns:
        return primary.select("doc_id", "label", "candidate_id", "logit")
    return score_terms(primary.select("doc_id", "label", "text"), weights, key_cols=["doc_id"])


def as_list(constraints) -> list[Constraint]:
    return [constraints] if isinstance(constraints, Constraint) else list(constraints)


def verdict_columns(constraints: list[Constraint]) -> list:
    """Report columns from ``n_<i>, d_<i>, mean_<i>, sd_<i>`` of each measure:
    counts, each measure's mean and sd, the largest upper bound and the verdict. A constraint
    without evidence has no bound, and then neither has the report, and it fails."""
    names = list(dict.fromkeys(c.measure for c in constraints))
    at = {m: i for i, m in enumerate(names)}
    n = [F.coalesce(f"n_{at[c.measure]}", F.lit(0)) for c in constraints]
    bounds = [t_upper_bound(k, F.col(f"mean_{at[c.measure]}"), F.col(f"sd_{at[c.measure]}"), c) for k, c in zip(n, constraints, strict=True)]
    known = reduce(lambda x, y: x & y, [b.isNotNull() for b in bounds])
    largest = bounds[0] if len(bounds) == 1 else F.when(known, F.greatest(*bounds))
    verdict = reduce(lambda x, y: x & y, [passes(b, k) for b, k in zip(bounds, n, strict=True)])
    counts = [F.coalesce(f"n_{i}", F.lit(0)) for i in range(len(names))]
    dropped = [F.coalesce(f"d_{i}", F.lit(0)) for i in range(len(names))]
    return [
        (counts[0] if len(names) == 1 else F.least(*counts)).cast("bigint").alias("n_groups"),
        (dropped[0] if len(names) == 1 else F.greatest(*dropped)).cast("bigint").alias("n_dropped"),
        *[x for i, m in enumerate(names) for x in (round6(f"mean_{i}").alias(f"mean_{m.lower()}"), round6(f"sd_{i}").alias(f"sd_{m.lower()}"))],
        round6(largest).alias("upper_bound"),
        verdict.alias("passed"),
    ]


def measure_summary(rows: list[tuple[str, F.Column]]) -> list:
    """Summary columns of :func:`verdict_columns` from each measure's value column."""
    out = []
    for i, (_, v) in enumerate(rows):
        out += [
            F.count(v).alias(f"n_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"sd_{i}"),
        ]
    return out


def safety_report(primary: DataFrame, groups: DataFrame, weights: DataFrame, constraint: Constraint | Sequence[Constraint] = VPROB) -> DataFrame:
    """Per model: loss on the labelled rows, a summary of each constraint's
    own measure over the groups, the largest upper bound, verdict (all
    constraints pass). An unregistered measure raises. ``primary`` is raw (doc_id, label, text) or
    pre-scored (doc_id, label, candidate_id, logit), see ``labelled_logits``."""
    constraints = as_list(constraint)
    names = list(dict.fromkeys(c.measure for c in constraints))
    scored = scored_rows(primary, weights)
    loss = cross_entropy(scored)
    members = score_terms(groups.select("group_id", "pos", "text"), weights, key_cols=["group_id", "pos"])
    long = group_measures(members, names)
    values = [(m, F.when(F.col("measure") == m, F.col("value"))) for m in names]
    dropped = [F.sum(F.when((F.col("measure") == m) & F.col("value").isNull(), 1).otherwise(0)).alias(f"d_{i}") for i, m in enumerate(names)]
    summary = long.groupBy("candidate_id").agg(*measure_summary(values), *dropped)
    joined = loss.join(summary, "candidate_id", "full")
    return joined.select("candidate_id", "n_rows", round6("loss").alias("loss"), *verdict_columns(constraints))


def split_measure_stats(primary: DataFrame, groups: DataFrame, weights: DataFrame, constraint: Constraint = VPROB) -> DataFrame:
    """Per candidate: loss on the candidate part of the labelled rows, and the
    constraint measure summarised on the candidate and safety parts of the
    groups (parts drawn per unit by hash).

    ``(candidate_id, loss, n, mean, sd, n_safety, mean_safety, sd_safety)``."""
    from ..operators.prep import safety_part

    scored = scored_rows(primary, weights)
    loss = cross_entropy(scored.filter(safety_part(F.col("doc_id")) == "candidate")).select("candidate_id", "loss")
    members = score_terms(groups.select("group_id", "pos", "text"), weights, key_cols=["group_id", "pos"])
    per_group = group_measures(members, [constraint.measure]).withColumn("part", safety_part(F.col("group_id")))
    summary = per_group.groupBy("candidate_id").agg(
        *[
            agg
            for part, sfx in (("candidate", ""), ("safety", "_safety"))
            for agg in (
                F.count(F.when(F.col("part") == part, F.col("value"))).alias(f"n{sfx}"),
                F.avg(F.when(F.col("part") == part, F.col("value"))).alias(f"mean{sfx}"),
                F.stddev_samp(F.when(F.col("part") == part, F.col("value"))).alias(f"sd{sfx}"),
            )
        ]
    )
    return loss.join(summary, "candidate_id", "full")


def corpus_safety_report(
    docs: DataFrame,
    labels: DataFrame,
    group_cols,
    weights: DataFrame,
    constraint: Constraint | Sequence[Constraint] = VPROB,
    labels_broadcast: bool | None = None,
) -> DataFrame:
    """:func:`safety_report` when the labelled rows and the group members are
    one corpus (documents grouped by columns): one scan and one scoring of
    every text, one shuffle of per-group rows (losses are summed map-side), one
    aggregation to K rows.
    """
    from .experiment import corpus_unit_values, mean_loss

    constraints = as_list(constraint)
    names = list(dict.fromkeys(c.measure for c in constraints))
    units, cands = corpus_unit_values(docs, labels, group_cols, weights, labels_broadcast, measures=tuple(names), fold=F.lit(0))
    k = len(cands)
    vals = units.select("kind", "n", "n_known", F.posexplode_outer("xs").alias("at", "x")).withColumn("cand_idx", F.col("at") % k)
    is_p, x = F.col("kind") == "p", F.col("x")
    mine = [(F.col("kind") == "g") & (F.floor(F.col("at") / k) == i) for i in range(len(names))]
    agg = vals.groupBy("cand_idx").agg(
        F.coalesce(F.sum(F.when(is_p, F.col("n"))), F.lit(0)).alias("n_rows"),
        mean_loss(is_p).alias("loss"),
        *measure_summary([(m, F.when(own, x)) for m, own in zip(names, mine, strict=True)]),
        *[F.sum(F.when(own & x.isNull(), 1).otherwise(0)).alias(f"d_{i}") for i, own in enumerate(mine)],
    )
    ids = F.array(*[F.lit(c) for c in cands])
    return agg.select(F.element_at(ids, F.col("cand_idx") + 1).alias("candidate_id"), "n_rows", round6("loss").alias("loss"), *verdict_columns(constraints))
