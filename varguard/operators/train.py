"""Model selection and training for linear term models.

* ``select_candidate``: lowest loss among candidates whose predicted safety
  bound is <= 0; none -> no solution.
* ``loss_gradient`` / ``variance_gradient``: exact gradients of the mean log
  loss and of the mean within-group variance with respect to every weight
  (bias = term NULL). Both are sums that Spark combines map-side; neither
  joins member rows back to their group.
* ``fit_constrained``: Adam on theta and gradient ascent on the multiplier
  lambda >= 0 of the Lagrangian loss + lambda * g, one Spark job per step
  (``train`` module docstring of each function gives the maths).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    ALPHA_LAMBDA,
    ALPHA_THETA,
    BETA_RMSPROP,
    BETA_VELOCITY,
    LAMBDA_INIT,
    N_EPOCHS,
    STABILITY_CONST,
    VPROB,
    Constraint,
)
from ..functions.scalar import log_loss, sigmoid
from .constraints import passes
from .score import parameter_frame, score_terms

def _null_term():
    return F.lit(None).cast("string")


def select_candidate(
    stats: DataFrame,
    by=(),
    loss_col: str = "loss",
    bound_col: str = "predicted_bound",
    n_col: str = "n",
    min_units: int = 2,
) -> DataFrame:
    """``(by..., solution_found, candidate_id, loss, predicted_bound)``: the
    feasible candidate with the lowest loss (ties: lowest id), or NULLs."""
    feasible = passes(F.col(bound_col), F.col(n_col), min_units) & F.col(loss_col).isNotNull()
    pick = F.min_by(
        F.when(feasible, F.struct("candidate_id", F.col(loss_col).alias("loss"), F.col(bound_col).alias("predicted_bound"))),
        F.when(feasible, F.struct(F.col(loss_col), F.col("candidate_id"))),
    )
    best = stats.groupBy(*by).agg(pick.alias("_b"))
    return best.select(
        *by,
        F.col("_b").isNotNull().alias("solution_found"),
        F.col("_b.candidate_id").alias("candidate_id"),
        F.col("_b.loss").alias("loss"),
        F.col("_b.predicted_bound").alias("predicted_bound"),
    )


def _dloss_dlogit(y, p, c: float = STABILITY_CONST):
    y = y.cast("double")
    return (-y / (p + F.lit(c)) + (F.lit(1.0) - y) / (F.lit(1.0) - p + F.lit(c))) * p * (F.lit(1.0) - p)


def loss_gradient(df: DataFrame, weights: DataFrame, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """d mean(log loss) / d w: ``(candidate_id, term, grad)``; term NULL = bias.

    Per row r = dL/dlogit; the gradient of a term weight is mean(r * count).
    Each row contributes r once per known token plus once for the bias, so
    one aggregation by (candidate, term) gives every entry; terms absent
    from the data have gradient 0 and no row."""
    sc = score_terms(df.select(label_col, text_col), weights, text_col=text_col, keep_hits=True)
    return loss_gradient_from_hits(sc.withColumnRenamed(label_col, "label"))


def loss_gradient_from_hits(sc: DataFrame) -> DataFrame:
    """:func:`loss_gradient` on scored rows ``(candidate_id, label, logit, hits)``."""
    p = sigmoid(F.col("logit"))
    rows = sc.select(
        "candidate_id",
        _dloss_dlogit(F.col("label"), p).alias("r"),
        F.explode_outer(F.concat(F.array(_null_term()), F.col("hits"))).alias("term"),
    )
    sums = rows.groupBy("candidate_id", "term").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("c"))
    n_rows = F.max(F.when(F.col("term").isNull(), F.col("c"))).over(Window.partitionBy("candidate_id"))
    return sums.select("candidate_id", "term", (F.col("s") / n_rows).alias("grad"))


def variance_gradient(members: DataFrame, weights: DataFrame, group_col: str = "group_id", text_col: str = "text") -> DataFrame:
    """d mean_g(var_samp(p in g)) / d w: ``(candidate_id, term, grad)``.

    For a group of n >= 2 members,
        d var / d w = 2/(n-1) * sum_i (p_i - pbar) * p_i (1 - p_i) * x_i
                    = 2/(n-1) * (A - pbar * B),
    A = sum_i p_i s_i x_i, B = sum_i s_i x_i, s_i = p_i (1 - p_i). A, B, n and
    sum p are plain sums per (group, term) — the bias row (term NULL, x = 1)
    carries n and sum p — so members are aggregated once, map-side, and only
    per-group rows meet in the join. One-member groups are dropped."""
    sc = score_terms(members.select(group_col, text_col), weights, text_col=text_col, keep_hits=True)
    return variance_gradient_from_hits(sc, group_col)


def variance_gradient_from_hits(sc: DataFrame, group_col: str = "group_id") -> DataFrame:
    """:func:`variance_gradient` on scored members ``(candidate_id, group, logit, hits)``."""
    p = sigmoid(F.col("logit"))
    rows = sc.select(
        "candidate_id",
        group_col,
        p.alias("p"),
        F.explode_outer(F.concat(F.array(_null_term()), F.col("hits"))).alias("term"),
    ).withColumn("s", F.col("p") * (F.lit(1.0) - F.col("p")))
    per_gt = rows.groupBy("candidate_id", group_col, "term").agg(
        F.sum(F.col("p") * F.col("s")).alias("a"),
        F.sum("s").alias("b"),
        F.count(F.lit(1)).alias("c"),
        F.sum("p").alias("sp"),
    )
    # n and pbar come from the group's bias row, spread over the group's
    # per-term rows (at most vocabulary + 1 rows per group, even for a hot
    # group). A window keeps one consumer of per_gt: a filtered branch joined
    # back would be planned as a second scan.
    grp = Window.partitionBy("candidate_id", group_col)
    bias_row = F.col("term").isNull()
    per_gt = per_gt.select(
        "candidate_id",
        "term",
        "a",
        "b",
        F.max(F.when(bias_row, F.col("c"))).over(grp).alias("n"),
        F.max(F.when(bias_row, F.col("sp") / F.col("c"))).over(grp).alias("pbar"),
    ).filter(F.col("n") >= 2)
    contrib = per_gt.select(
        "candidate_id",
        "term",
        (F.lit(2.0) / (F.col("n") - 1) * (F.col("a") - F.col("pbar") * F.col("b"))).alias("d"),
        F.when(F.col("term").isNull(), 1).otherwise(0).alias("is_group"),
    )
    sums = contrib.groupBy("candidate_id", "term").agg(F.sum("d").alias("s"), F.sum("is_group").alias("g"))
    n_groups = F.max(F.when(F.col("term").isNull(), F.col("g"))).over(Window.partitionBy("candidate_id"))
    return sums.select("candidate_id", "term", (F.col("s") / n_groups).alias("grad"))


@dataclass(frozen=True)
class DescentConfig:
    lambda_init: float = LAMBDA_INIT
    alpha_theta: float = ALPHA_THETA
    alpha_lambda: float = ALPHA_LAMBDA
    beta_velocity: float = BETA_VELOCITY
    beta_rmsprop: float = BETA_RMSPROP
    n_epochs: int = N_EPOCHS
    eps: float = 1e-8


def _known_words(df: DataFrame, model: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` with only the words the model knows left of its texts, written
    once to the shared folder: what every step reads."""
    from ..session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    hits = score_terms(df.select(*keys, "text"), model, keep_hits=True)
    hits.select(*keys, F.concat_ws(" ", "hits").alias("text")).write.parquet(path)
    return spark.read.parquet(path)


def _primary_step(pb: DataFrame) -> DataFrame:
    """One aggregation: per term the summed dL/dlogit; the bias row (term
    NULL) also carries the summed loss and the row count."""
    p = sigmoid(F.col("logit"))
    rows = pb.select(
        _dloss_dlogit(F.col("label"), p).alias("r"),
        log_loss("label", p).alias("loss"),
        F.explode_outer(F.concat(F.array(_null_term()), F.col("hits"))).alias("term"),
    )
    return rows.groupBy("term").agg(
        F.sum("r").alias("s"),
        F.sum(F.when(F.col("term").isNull(), F.col("loss"))).alias("loss_sum"),
        F.count(F.lit(1)).alias("c"),
    ).select(F.lit("p").alias("side"), "term", "s", "loss_sum", F.col("c").cast("double").alias("c"))


def _group_step(gb: DataFrame, sign: float = 1.0, k: float | None = None) -> DataFrame:
    """Gradient of the constraint target over all groups, per term, in one pass.

    With per-group variances v_g (groups with n >= 2), their mean vbar, sample
    sd s and count G, the target is ``sign * vbar`` (point) or, when ``k`` is
    given, the predicted bound ``sign * vbar + k * s`` with
    ``k = 2 t(1 - delta, n_safety - 1) / sqrt(n_safety)``. With
    ``dv_g = 2 / (n_g - 1) (A_g - pbar_g B_g)`` (see variance_gradient) and
    D1 = sum_g dv_g, D2 = sum_g v_g dv_g its gradient is
    ``sign D1 / G + k (D2 - vbar D1) / (s (G - 1))``: plain sums per term,
    combined map-side; only the term-sized result meets vbar, s and G.
    Output rows ``(side, term, s, loss_sum, c)``: ``s`` is the gradient entry;
    the bias row carries the target value and G."""
    p = sigmoid(F.col("logit"))
    rows = gb.select(
        "group_id", p.alias("p"), F.explode_outer(F.concat(F.array(_null_term()), F.col("hits"))).alias("term")
    ).withColumn("s", F.col("p") * (F.lit(1.0) - F.col("p")))
    per_gt = rows.groupBy("group_id", "term").agg(
        F.sum(F.col("p") * F.col("s")).alias("a"),
        F.sum("s").alias("b"),
        F.count(F.lit(1)).alias("c"),
        F.sum("p").alias("sp"),
        F.var_samp("p").alias("v"),
    )
    # per-group values from the group's bias row, spread over its terms
    grp = Window.partitionBy("group_id")
    bias_row = F.col("term").isNull()
    staged = per_gt.select(
        "term",
        "a",
        "b",
        F.max(F.when(bias_row, F.col("c"))).over(grp).alias("n"),
        F.max(F.when(bias_row, F.col("sp") / F.col("c"))).over(grp).alias("pbar"),
        F.max(F.when(bias_row, F.col("v"))).over(grp).alias("v"),
    ).filter(F.col("n") >= 2)
    dv = F.lit(2.0) / (F.col("n") - 1) * (F.col("a") - F.col("pbar") * F.col("b"))
    unit = F.when(F.col("term").isNull(), F.col("v"))
    sums = staged.groupBy("term").agg(
        F.sum(dv).alias("d1"),
        F.sum(F.col("v") * dv).alias("d2"),
        F.avg(unit).alias("vbar"),
        F.stddev_samp(unit).alias("sd"),
        F.count(unit).alias("G"),
    )
    every = Window.partitionBy(F.lit(0))  # one row per parameter
    sums = sums.select("term", "d1", "d2", *[F.max(c).over(every).alias(c) for c in ("vbar", "sd", "G")])
    grad, value = F.lit(sign) * F.col("d1") / F.col("G"), F.lit(sign) * F.col("vbar")
    if k is not None:
        spread = (F.col("sd") > 0) & (F.col("G") >= 2)
        bent = F.lit(k) * (F.col("d2") - F.col("vbar") * F.col("d1")) / (F.col("sd") * (F.col("G") - 1))
        grad = grad + F.when(spread, bent).otherwise(0.0)
        value = value + F.lit(k) * F.coalesce("sd", F.lit(0.0))
    at_bias = F.col("term").isNull()
    return sums.select(
        F.lit("g").alias("side"),
        "term",
        grad.alias("s"),
        F.when(at_bias, value).alias("loss_sum"),
        F.when(at_bias, F.col("G").cast("double")).alias("c"),
    )


def fit_constrained(
    primary: DataFrame,
    groups: DataFrame,
    init_weights: dict,
    init_bias: float,
    cfg: DescentConfig = DescentConfig(),
    constraint: Constraint = VPROB,
    n_safety: int | None = None,
):
    """Constrained descent on a linear term model, ``cfg.n_epochs`` steps.

    Lagrangian ``loss(theta) + lambda * g(theta)``. With ``n_safety`` (the
    number of safety units) g is the predicted high-confidence bound of the
    constraint, ``sign*mean + 2 sd / sqrt(n_safety) * t(1 - delta, n_safety - 1)
    - sign*threshold`` — what candidate selection tests; without it, the point
    value ``sign*mean - sign*threshold``. theta follows Adam on the Lagrangian
    gradient; lambda >= 0 follows gradient ascent on g.

    Every step uses all rows and all groups: one Spark job of map-side combined
    sums, which returns one row per parameter and side. Between steps theta is
    a small parameter table. Returns ``(theta, bias, log rows)``; a log row is
    ``(step, loss, g, lam, theta)``, all before the update; theta lists
    ``(term, weight, grad)``, grad that of the Lagrangian, the bias under term NULL. Without any row there is no
    step: theta stays and the log is empty.
    """
    spark = primary.sparkSession
    names = [None, *sorted(init_weights)]
    theta = {None: float(init_bias), **{t: float(w) for t, w in init_weights.items()}}
    model = lambda: parameter_frame(spark, [(0, t, theta[t]) for t in names])
    p_feat = _known_words(primary, model(), ["label"], "descent-primary")
    g_feat = _known_words(groups, model(), ["group_id"], "descent-groups")
    m, v, lam, log = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), float(cfg.lambda_init), []
    thr = constraint.sign * constraint.threshold
    k = None
    if n_safety is not None and n_safety >= 2:
        from ..functions.stats import t_ppf

        k = 2.0 * t_ppf(1.0 - constraint.delta, n_safety - 1) / float(n_safety) ** 0.5
    for step in range(1, cfg.n_epochs + 1):
        w = model()
        sides = _primary_step(score_terms(p_feat, w, keep_hits=True)).unionByName(
            _group_step(score_terms(g_feat, w, keep_hits=True), constraint.sign, k)
        )
        got = {(r.side, r.term): r for r in sides.collect()}  # one row per parameter and side
        rows, target = got.get(("p", None)), got.get(("g", None))
        if rows is None:
            break
        loss_v, g_v = rows.loss_sum / rows.c, None if target is None else target.loss_sum - thr
        grads = {}
        for t in names:
            dp, dg = got.get(("p", t)), got.get(("g", t))
            grads[t] = (dp.s / rows.c if dp else 0.0) + (lam * dg.s if dg else 0.0)
        log.append((step, loss_v, g_v, lam, [(t, theta[t], grads[t]) for t in names]))
        for t in names:
            grad = grads[t]
            m[t] = cfg.beta_velocity * m[t] + (1 - cfg.beta_velocity) * grad
            v[t] = cfg.beta_rmsprop * v[t] + (1 - cfg.beta_rmsprop) * grad * grad
            mh, vh = m[t] / (1 - cfg.beta_velocity**step), v[t] / (1 - cfg.beta_rmsprop**step)
            theta[t] -= cfg.alpha_theta * mh / (vh**0.5 + cfg.eps)
        if g_v is not None:
            lam = max(0.0, lam + cfg.alpha_lambda * g_v)
    return {t: theta[t] for t in names[1:]}, theta[None], log


LOG_SCHEMA = "step int, loss double, g double, lam double, theta array<struct<term:string,weight:double,grad:double>>"


def best_iterate(log: DataFrame) -> DataFrame:
    """Lowest-loss logged step whose g is <= 0, with its parameters
    (``solution_found`` false if none)."""
    ok = F.coalesce(F.col("g") <= 0, F.lit(False)) & F.col("loss").isNotNull()
    best = log.agg(F.min_by(F.when(ok, F.struct("step", "loss", "g", "theta")), F.when(ok, F.struct("loss", "step"))).alias("_b"))
    return best.select(F.col("_b").isNotNull().alias("solution_found"), *[F.col(f"_b.{c}").alias(c) for c in ("step", "loss", "g", "theta")])
