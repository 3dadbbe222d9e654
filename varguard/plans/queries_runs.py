"""Registered queries with side effects or driver loops: result sinks read
back (SNK1-3, SRC4) and constrained descent (TRN4-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LEXICON, LEXICON_BIAS, VPROB
from ..functions.scalar import round6
from ..operators.minibatch import LOG_SCHEMA as MINIBATCH_LOG
from ..operators.minibatch import MiniBatchConfig, fit_minibatch
from ..operators.prep import safety_part
from ..operators.train import LOG_SCHEMA, DescentConfig, best_iterate, fit_constrained
from ..session import scratch_path
from ..sources.named import write_named_trials
from ..sources.results import pool_trials, read_trials, write_log, write_trials
from ..sources.standins import document_groups, primary_table
from . import oracle as O
from .catalog import register
from .queries_experiment import _experiment, _wrap, ex1_sql


@register("snk1_src4_trials_roundtrip", ex1_sql)
def snk1_src4_trials_roundtrip(spark, sf_dir):
    """Experiment cells written one unit per (frac_id, trial_i) under the shared
    checkpoint folder, then read back (gvec decoded from text)."""
    path = scratch_path(spark, "trials")
    write_trials(_experiment(spark, sf_dir), path)
    return read_trials(spark, path)


@register("snk2_pool_trials", ex1_sql)
def snk2_pool_trials(spark, sf_dir):
    """All cells pooled into one table ordered by (frac_id, trial_i)."""
    path = scratch_path(spark, "trials")
    write_trials(_experiment(spark, sf_dir), path)
    return pool_trials(read_trials(spark, path))


@register(
    "src4_named_trials",
    lambda: _wrap(
        """SELECT round(data_frac, 4) AS file_data_frac, trial_i AS file_trial_i, round(data_frac, 10) AS data_frac, trial_i,
        performance, passed_safety, gvec FROM r"""
    ),
)
def src4_named_trials(spark, sf_dir):
    """Experiment cells in files named by their cell, one row each; the key is read back from the file names."""
    path = scratch_path(spark, "named")
    write_named_trials(_experiment(spark, sf_dir), path)
    return read_trials(spark, path, "named").withColumn("data_frac", F.round("data_frac", 10))


@register("trn4_minibatch")
def trn4_minibatch(spark, sf_dir):
    """Descent in mini-batches of 12 labelled rows and 5 groups, three epochs, eight shards averaged after each: a
    row per epoch and parameter."""
    primary, groups, n_safety = _fit_tables(spark, sf_dir)
    cfg = MiniBatchConfig(alpha_theta=0.001, alpha_lambda=0.005)
    _, _, log = fit_minibatch(primary, groups, dict.fromkeys(LEXICON, 1.0), LEXICON_BIAS, cfg, VPROB, n_safety, shards=8)
    rows = spark.createDataFrame(log, MINIBATCH_LOG).select("epoch", "steps", *[round6(c).alias(c) for c in ("loss", "g", "lam")], F.explode("theta").alias("_t"))
    return rows.select("epoch", "steps", "loss", "g", "lam", "_t.term", round6("_t.weight").alias("weight"))


def _fit_tables(spark, sf_dir):
    primary = primary_table(spark, sf_dir).filter(safety_part(F.col("doc_id")) == "candidate")
    all_groups = document_groups(spark, sf_dir).withColumn("part", safety_part(F.col("group_id")))
    groups = all_groups.filter(F.col("part") == "candidate").drop("part")
    sizes = all_groups.filter(F.col("part") == "safety").groupBy("group_id").count()
    n_safety = sizes.filter("count >= 2").count()  # the units a safety test will have
    return primary, groups, n_safety


def _fit(spark, sf_dir):
    primary, groups, n_safety = _fit_tables(spark, sf_dir)
    _, _, log = fit_constrained(primary, groups, dict.fromkeys(LEXICON, 1.0), LEXICON_BIAS, DescentConfig(), VPROB, n_safety)
    return spark.createDataFrame(log, LOG_SCHEMA)


def _log_rows(log):
    """A row per step and parameter."""
    rows = log.select("step", *[round6(c).alias(c) for c in ("loss", "g", "lam")], F.explode_outer("theta").alias("_t"))
    return rows.select("step", "loss", "g", "lam", "_t.term", round6("_t.weight").alias("weight"), round6("_t.grad").alias("grad"))


def _descent_sql(select: str) -> str:
    """The steps unrolled: ``th<s>`` holds theta and Adam's moments before step s
    (the bias under the empty term), ``f<s>`` the step's loss, g and lambda."""
    cfg, p = DescentConfig(), O.sigmoid("z")
    slope = f"(-CAST(label AS DOUBLE) / (p + {O.C}) + (1.0 - label) / (1.0 - p + {O.C})) * p * (1.0 - p)"
    words = lambda key, base: f"SELECT {key}, term FROM (SELECT {key}, unnest({O.tokens_sql('text')}) AS term FROM {base}) WHERE term IN ({', '.join(map(O.q, LEXICON))})"
    start = ", ".join([f"('', {LEXICON_BIAS!r}::DOUBLE)"] + [f"({O.q(t)}, 1.0)" for t in LEXICON])
    parts = [
        f"docs AS MATERIALIZED (SELECT * FROM ({O.PRIMARY}) WHERE {O.safety_part('doc_id')} = 'candidate')",
        f"allg AS MATERIALIZED (SELECT *, {O.safety_part('group_id')} AS part FROM ({O.GROUPS_LS}))",
        "members AS MATERIALIZED (SELECT group_id, pos, text FROM allg WHERE part = 'candidate')",
        "ns AS (SELECT count(*) AS n FROM (SELECT group_id FROM allg WHERE part = 'safety' GROUP BY group_id HAVING count(*) >= 2))",
        f"kk AS MATERIALIZED (SELECT 2.0 * {O.t_q('(n - 1)', 1 - VPROB.delta)} / sqrt(n) AS k FROM ns)",
        f"dw AS MATERIALIZED ({words('doc_id', 'docs')})",
        f"gw AS MATERIALIZED ({words('pos', 'members')})",
        f"th1 AS (SELECT term, w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (VALUES {start}) AS t(term, w))",
        f"l1 AS (SELECT {cfg.lambda_init!r}::DOUBLE AS lam)",
    ]
    for i in range(1, cfg.n_epochs + 1):
        bias = f"(SELECT w FROM th{i} WHERE term = '')"
        parts += [
            f"dz{i} AS (SELECT doc_id, sum(w) AS s FROM dw JOIN th{i} USING (term) GROUP BY doc_id)",
            f"ds{i} AS MATERIALIZED (SELECT doc_id, {slope} AS r, {O.log_loss('label', 'p')} AS loss FROM (SELECT *, {p} AS p FROM "
            f"(SELECT doc_id, label, {bias} + coalesce(s, 0) AS z FROM docs LEFT JOIN dz{i} USING (doc_id))))",
            f"dl{i} AS (SELECT '' AS term, avg(r) AS d FROM ds{i} UNION ALL "
            f"SELECT term, sum(r) / (SELECT count(*) FROM ds{i}) FROM dw JOIN ds{i} USING (doc_id) GROUP BY term)",
            f"gz{i} AS (SELECT pos, sum(w) AS s FROM gw JOIN th{i} USING (term) GROUP BY pos)",
            f"gp{i} AS MATERIALIZED (SELECT group_id, pos, {p} AS p FROM "
            f"(SELECT group_id, pos, {bias} + coalesce(s, 0) AS z FROM members LEFT JOIN gz{i} USING (pos)))",
            f"gv{i} AS MATERIALIZED (SELECT group_id, count(*) AS n, avg(p) AS pbar, var_samp(p) AS v FROM gp{i} GROUP BY group_id HAVING count(*) >= 2)",
            f"st{i} AS (SELECT count(*) AS c, avg(v) AS vbar, stddev_samp(v) AS sd FROM gv{i})",
            f"co{i} AS MATERIALIZED (SELECT pos, 2.0 / (n - 1) * (p - pbar) * p * (1.0 - p) * "
            f"({VPROB.sign!r} / c + k * (v - vbar) / (sd * (c - 1))) AS d FROM gp{i} JOIN gv{i} USING (group_id), st{i}, kk)",
            f"dg{i} AS (SELECT '' AS term, sum(d) AS d FROM co{i} UNION ALL SELECT term, sum(d) FROM gw JOIN co{i} USING (pos) GROUP BY term)",
            f"f{i} AS MATERIALIZED (SELECT (SELECT avg(loss) FROM ds{i}) AS loss, "
            f"{VPROB.sign!r} * vbar + k * sd - {VPROB.sign * VPROB.threshold!r} AS g, lam FROM st{i}, kk, l{i})",
            f"am{i} AS MATERIALIZED (SELECT t.term, t.w, {cfg.beta_velocity!r} * m + {1 - cfg.beta_velocity!r} * x AS m, "
            f"{cfg.beta_rmsprop!r} * v + {1 - cfg.beta_rmsprop!r} * x * x AS v, x FROM (SELECT th{i}.*, coalesce(dl{i}.d, 0) + lam * coalesce(dg{i}.d, 0) AS x "
            f"FROM th{i} LEFT JOIN dl{i} USING (term) LEFT JOIN dg{i} USING (term), l{i}) t)",
            f"th{i + 1} AS MATERIALIZED (SELECT term, w - {cfg.alpha_theta!r} * (m / {1 - cfg.beta_velocity**i!r}) / "
            f"(sqrt(v / {1 - cfg.beta_rmsprop**i!r}) + {cfg.eps!r}) AS w, m, v FROM am{i})",
            f"l{i + 1} AS MATERIALIZED (SELECT greatest(0.0, lam + {cfg.alpha_lambda!r} * g) AS lam FROM f{i})",
        ]
    log = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS step, loss, g, lam, nullif(term, '') AS term, w, x FROM f{i}, am{i}" for i in range(1, cfg.n_epochs + 1)
    )
    return f"WITH {', '.join(parts)}, log AS ({log}) {select}"


LOG_SQL = "SELECT step, round(loss, 6) AS loss, round(g, 6) AS g, round(lam, 6) AS lam, term, round(w, 6) AS weight, round(x, 6) AS grad FROM log"


@register("trn4_fit_constrained", lambda: _descent_sql(LOG_SQL))
def trn4_fit_constrained(spark, sf_dir):
    """Adam on theta / ascent on lambda, three steps over the whole candidate
    part, penalising the predicted safety bound (sized by the safety groups);
    one row per step and parameter."""
    return _log_rows(_fit(spark, sf_dir))


def _best_sql():
    best = "(SELECT step FROM log WHERE g <= 0 AND loss IS NOT NULL ORDER BY loss, step LIMIT 1)"
    return _descent_sql(
        f"""SELECT b.step IS NOT NULL AS solution_found, b.step, round(loss, 6) AS loss, round(g, 6) AS g, term, round(w, 6) AS weight
        FROM (SELECT {best} AS step) b LEFT JOIN log ON log.step = b.step"""
    )


@register("trn5_best_iterate", _best_sql)
def trn5_best_iterate(spark, sf_dir):
    """Best feasible iterate of the descent log, with its parameters."""
    best = best_iterate(_fit(spark, sf_dir)).select("*", F.explode_outer("theta").alias("_t"))
    return best.select(
        "solution_found", "step", round6("loss").alias("loss"), round6("g").alias("g"), "_t.term", round6("_t.weight").alias("weight")
    )


@register("snk3_write_log", lambda: _descent_sql(LOG_SQL))
def snk3_write_log(spark, sf_dir):
    """Descent log appended to a table in the shared folder and read back."""
    path = scratch_path(spark, "descent-log")
    write_log(_fit(spark, sf_dir), path)
    return _log_rows(spark.read.parquet(path))


@register("snk2_stream_pool", ex1_sql)
def snk2_stream_pool(spark, sf_dir):
    """Cells pooled by a file-source stream into a parquet table (exactly once)."""
    from ..streaming.pool import start_pooling

    cells = scratch_path(spark, "cells")
    write_trials(_experiment(spark, sf_dir), cells)
    pooled, ckpt = scratch_path(spark, "pooled"), scratch_path(spark, "pool-ckpt")
    q = start_pooling(spark, cells, pooled, ckpt)
    q.awaitTermination()
    return spark.read.parquet(pooled)


def _stream_rate_sql():
    return _wrap(
        """SELECT frac_id, data_frac, count(*) AS n_trials, round(avg(CAST(passed_safety AS DOUBLE)), 6) AS solution_rate,
        round(sqrt(avg(CAST(passed_safety AS DOUBLE)) * (1.0 - avg(CAST(passed_safety AS DOUBLE))) / count(*)), 6) AS se_solution_rate
        FROM r GROUP BY frac_id, data_frac"""
    )


@register("ex4_stream_solution_rate", _stream_rate_sql)
def ex4_stream_solution_rate(spark, sf_dir):
    """Solution rate per fraction kept current by a streaming aggregation."""
    from ..functions.scalar import round6
    from ..streaming.pool import start_rate_report

    cells = scratch_path(spark, "cells")
    write_trials(_experiment(spark, sf_dir), cells)
    report, ckpt = scratch_path(spark, "rate"), scratch_path(spark, "rate-ckpt")
    q = start_rate_report(spark, cells, report, ckpt)
    q.awaitTermination()
    out = spark.read.parquet(report)
    return out.select("frac_id", "data_frac", "n_trials", round6("solution_rate").alias("solution_rate"),
                      round6("se_solution_rate").alias("se_solution_rate"))
