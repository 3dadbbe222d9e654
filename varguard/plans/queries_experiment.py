"""Registered queries: resampling and grid (BS1-3, GR1-4), the experiment and
its reports (EX1-7), result codecs (SRC5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EXPERIMENT_CANDIDATE_WEIGHTS, N_TRIALS, VPROB, Constraint, ExperimentConfig
from ..functions.scalar import round6
from ..operators.constraints import ENTROPIC_T
from ..operators.resample import (
    bootstrap,
    bootstrap_weights,
    frac_grid,
    frac_ids,
    pending_trials,
    poisson_cdf,
    trial_grid,
)
from ..operators.score import lexicon_model
from ..sources.results import decode_gvec, encode_gvec, read_trials, write_pooled, write_trials
from ..session import load_table, scratch_path
from ..sources.standins import document_groups, labels_table, primary_table
from . import oracle as O
from .catalog import register
from .experiment import (
    abs_size,
    corpus_unit_values,
    failure_rate,
    learning_curve,
    mean_loss,
    reconcile,
    results_from_units,
    resume_experiment,
    run_corpus_experiment,
    solution_rate,
)

CFG = ExperimentConfig()
FRACS = list(CFG.fracs)
W4 = O.weights_values(tuple(EXPERIMENT_CANDIDATE_WEIGHTS))


def _case_steps(u: str, steps) -> str:
    body = " ".join(f"WHEN {u} < {s!r} THEN {k}" for k, s in enumerate(steps))
    return f"(CASE {body} ELSE {len(steps)} END)"


def _min_frac_sql(u: str) -> str:
    body = " ".join(f"WHEN {u} < {f!r} THEN {k}" for k, f in enumerate(FRACS))
    return f"(CASE {body} ELSE {len(FRACS) - 1} END)"


def _hex_u(h: str, slot: int) -> str:
    return f"(CAST(CAST(('0x' || substr({h}, {1 + 8 * slot}, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"


POISSON = poisson_cdf()


def _experiment(spark, sf_dir, cfg=CFG):
    w = lexicon_model(spark, tuple(EXPERIMENT_CANDIDATE_WEIGHTS))
    labels, small = labels_table(spark, sf_dir)
    docs = load_table(spark, sf_dir, "documents")
    return run_corpus_experiment(docs, labels, ("lang", "source"), w, cfg, labels_broadcast=small)


#: Group measures of :func:`ex1_sql` as DuckDB aggregates of p.
MEASURE_SQL = {
    "VPROB": "var_samp(p)",
    "VRANGE": "CASE WHEN count(*) >= 2 THEN max(p) - min(p) END",
    "VENTROPIC": f"CASE WHEN count(*) >= 2 THEN ln(avg(exp({ENTROPIC_T!r} * p))) / {ENTROPIC_T!r} - avg(p) END",
}
RIGHT = "CAST((p >= 0.5) = (label = 1) AS DOUBLE)"
#: Metrics as DuckDB aggregates over rows (label, p).
METRIC_SQL = {
    "log_loss": f"avg({O.log_loss('label', 'p')})",
    "brier": "avg((p - label) * (p - label))",
    "balanced_accuracy": f"(avg({RIGHT}) FILTER (label = 1) + avg({RIGHT}) FILTER (label = 0)) / 2",
}
#: The objectives that have one term: a row's value.
TERM_SQL = {"log_loss": O.log_loss("label", "p"), "brier": "(p - label) * (p - label)"}


def ex1_sql(cfg=CFG) -> str:
    cs = list(enumerate(cfg.all_constraints))
    gk = {m: f"g{j or ''}" for j, m in enumerate(cfg.measures)}
    evaluated = [gk[m] for m in cfg.evaluation_measures]
    ps = O.scored(O.PRIMARY, ["doc_id"], ["label"], W4)
    gs = O.scored(O.GROUPS_LS, ["group_id", "pos"], [], W4)
    fr = ", ".join(f"({k}, CAST({f!r} AS DOUBLE))" for k, f in enumerate(FRACS))

    def sd(n, s1, s2):
        return f"CASE WHEN {n} >= 2 THEN sqrt(greatest(({s2} - {s1} * {s1} / {n}) / ({n} - 1), 0.0)) END"

    def pk(kind, part, e):
        return f"max(CASE WHEN kind = '{kind}' AND part = '{part}' THEN {e} END)"

    def on_all(form):
        return " AND ".join(form.format(i=i) for i, _ in cs)

    groups = " UNION ALL ".join(f"SELECT '{k}', group_id, candidate_id, {MEASURE_SQL[m]} FROM gp GROUP BY group_id, candidate_id" for m, k in gk.items())
    kinds = ", ".join(f"('{k}')" for k in ("p", *gk.values()))
    true_g = ", ".join(f"avg(CASE WHEN kind = '{k}' THEN x END) AS vmean{i}" for i, k in enumerate(evaluated))
    sums = ", ".join(
        f"{pk(gk[c.measure], part, col)} AS {name}{part[0]}{i}"
        for i, c in cs for part in ("candidate", "safety") for col, name in (("sw", "n_"), ("swx", "s1_"), ("swx2", "s2_"), ("nu", "nu_"))
    )
    stats = ", ".join(
        f"CASE WHEN n_{s}{i} > 0 THEN s1_{s}{i} / n_{s}{i} END AS mean_{s}{i}, {sd(f'n_{s}{i}', f's1_{s}{i}', f's2_{s}{i}')} AS sd_{s}{i}"
        for i, _ in cs for s in "cs"
    )

    def bound(i, c, part, wide):
        t = O.t_q(f"n_s{i} - 1", 1 - c.delta)
        return f"CASE WHEN n_s{i} >= 2 THEN {c.sign!r} * mean_{part}{i} + {wide} * sd_{part}{i} / sqrt(n_s{i}) * {t} - {c.sign * c.threshold!r} END"

    both = ", ".join(f"{bound(i, c, 'c', 2.0)} AS pb{i}, {bound(i, c, 's', 1.0)} AS sb{i}" for i, c in cs)
    g_true = ", ".join(f"round({c.sign!r} * truth.vmean{i} - {c.sign * c.threshold!r}, 6)" for i, c in cs)
    no_g = ", ".join("CAST('-inf' AS DOUBLE)" for _ in cs)
    return f"""WITH ps AS {ps},
    gs AS {gs},
    gp AS (SELECT *, {O.sigmoid('logit')} AS p FROM gs),
    pp AS (SELECT *, {O.sigmoid('logit')} AS p FROM ps),
    u AS (SELECT 'p' AS kind, doc_id AS unit, candidate_id, {TERM_SQL[cfg.objective]} AS x FROM pp
          UNION ALL {groups}),
    perf AS (SELECT candidate_id, {METRIC_SQL[cfg.performance]} AS perf FROM pp GROUP BY candidate_id),
    truth AS (SELECT candidate_id, any_value(perf) AS perf, {true_g}
              FROM u JOIN perf USING (candidate_id) GROUP BY candidate_id),
    ut AS (SELECT u.*, t.trial_i, md5(concat_ws(':', {O.SEED_S}, 'trial', t.trial_i, u.kind[1], u.unit)) AS h
           FROM u, range({CFG.n_trials}) t(trial_i) WHERE u.x IS NOT NULL),
    s AS (SELECT trial_i, kind, candidate_id, x,
            CASE WHEN {_hex_u('h', 0)} < {CFG.frac_safety!r} THEN 'safety' ELSE 'candidate' END AS part,
            {_case_steps(_hex_u('h', 1), POISSON)} AS w,
            {_min_frac_sql(_hex_u('h', 2))} AS frac_id FROM ut),
    m AS (SELECT trial_i, kind, part, frac_id, candidate_id, sum(w) AS sw, sum(w * x) AS swx, sum(w * x * x) AS swx2,
            count(*) AS nu FROM s WHERE w > 0 GROUP BY ALL),
    grid AS (SELECT t.trial_i, k.kind, pa.part, f.frac_id, c.candidate_id
             FROM range({CFG.n_trials}) t(trial_i), (VALUES {kinds}) k(kind), (VALUES ('candidate'), ('safety')) pa(part),
                  range({len(FRACS)}) f(frac_id), (SELECT DISTINCT candidate_id FROM truth) c),
    cum AS (SELECT g.trial_i, g.kind, g.part, g.frac_id, g.candidate_id,
              sum(coalesce(m.sw, 0)) OVER win AS sw, sum(coalesce(m.swx, 0)) OVER win AS swx,
              sum(coalesce(m.swx2, 0)) OVER win AS swx2, sum(coalesce(m.nu, 0)) OVER win AS nu
            FROM grid g LEFT JOIN m ON g.trial_i = m.trial_i AND g.kind = m.kind AND g.part = m.part
              AND g.frac_id = m.frac_id AND g.candidate_id = m.candidate_id
            WINDOW win AS (PARTITION BY g.trial_i, g.kind, g.part, g.candidate_id ORDER BY g.frac_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    cell AS (SELECT trial_i, frac_id, candidate_id,
               {pk('p', 'candidate', 'CASE WHEN sw > 0 THEN swx / sw END')} AS loss_c,
               {sums}
             FROM cum GROUP BY trial_i, frac_id, candidate_id),
    st AS (SELECT *, {stats} FROM cell),
    b AS (SELECT *, {both} FROM st),
    f AS (SELECT *, row_number() OVER (PARTITION BY trial_i, frac_id ORDER BY loss_c, candidate_id) AS rk
          FROM b WHERE {on_all(f"coalesce(pb{{i}} <= 0, false) AND nu_c{{i}} >= {CFG.min_units}")} AND loss_c IS NOT NULL),
    sel AS (SELECT trial_i, frac_id, candidate_id, {on_all(f"coalesce(sb{{i}} <= 0, false) AND nu_s{{i}} >= {CFG.min_units}")} AS ok FROM f WHERE rk = 1),
    cells AS (SELECT t.trial_i, fr.frac_id, fr.data_frac FROM range({CFG.n_trials}) t(trial_i), (VALUES {fr}) fr(frac_id, data_frac))
    SELECT CAST(cells.frac_id AS INTEGER) AS frac_id, cells.data_frac, CAST(cells.trial_i AS INTEGER) AS trial_i,
      sel.candidate_id, CASE WHEN coalesce(sel.ok, false) THEN round(truth.perf, 6) END AS performance,
      coalesce(sel.ok, false) AS passed_safety,
      CASE WHEN coalesce(sel.ok, false) THEN [{g_true}] ELSE [{no_g}] END AS gvec
    FROM cells LEFT JOIN sel ON cells.trial_i = sel.trial_i AND cells.frac_id = sel.frac_id
    LEFT JOIN truth ON sel.candidate_id = truth.candidate_id"""


@register("ex1_run_experiment", ex1_sql)
def ex1_run_experiment(spark, sf_dir):
    """10 fractions x 10 bootstrap trials of select-then-safety-test, one plan."""
    return _experiment(spark, sf_dir)


TWO = ExperimentConfig(constraints=(VPROB, Constraint("VRANGE <= 0.55", "VRANGE", "<=", 0.55, 0.1)))
USER = ExperimentConfig(
    constraints=(VPROB, Constraint("VENTROPIC <= 0.12", "VENTROPIC", "<=", 0.12, 0.05)),
    objective="brier",
    performance="balanced_accuracy",
    evaluations=("VRANGE", None),
)


@register("ex1_two_constraints", lambda: ex1_sql(TWO))
def ex1_two_constraints(spark, sf_dir):
    """The experiment under a list of constraints, each with its own measure, threshold and delta: a solution is safe
    under both, gvec has both."""
    return _experiment(spark, sf_dir, TWO)


@register("ex1_user_functions", lambda: ex1_sql(USER))
def ex1_user_functions(spark, sf_dir):
    """The experiment with functions of the user's: another objective, a performance metric of several terms, a
    constraint on a measure in Python, another evaluation of the first constraint's true g."""
    return _experiment(spark, sf_dir, USER)


@register("gr4_resume", ex1_sql)
def gr4_resume(spark, sf_dir):
    """An interrupted grid resumed: all but the last trials and fractions are recorded first, the rest is computed and appended."""
    w = lexicon_model(spark, tuple(EXPERIMENT_CANDIDATE_WEIGHTS))
    labels, small = labels_table(spark, sf_dir)
    units, cands = corpus_unit_values(load_table(spark, sf_dir, "documents"), labels, ("lang", "source"), w, small)
    units = units.checkpoint()
    path = scratch_path(spark, "cells")
    done = (F.col("trial_i") < N_TRIALS - 3) | ((F.col("trial_i") == N_TRIALS - 1) & (F.col("frac_id") > 4))
    write_trials(results_from_units(units, cands, CFG).filter(done), path)
    resume_experiment(units, cands, path, CFG)
    return read_trials(spark, path)


@register(
    "ex2_ground_truth",
    lambda: f"""WITH ps AS {O.scored(O.PRIMARY, ['doc_id'], ['label'], W4)},
    gs AS {O.scored(O.GROUPS_LS, ['group_id', 'pos'], [], W4)},
    v AS (SELECT candidate_id, group_id, var_samp({O.sigmoid('logit')}) AS v FROM gs GROUP BY ALL),
    p AS (SELECT candidate_id, avg({O.log_loss('label', O.sigmoid('logit'))}) AS perf FROM ps GROUP BY ALL),
    g AS (SELECT candidate_id, avg(v) - {VPROB.threshold!r} AS g FROM v GROUP BY ALL)
    SELECT p.candidate_id, round(perf, 6) AS performance, round(g, 6) AS g FROM p JOIN g ON p.candidate_id = g.candidate_id""",
)
def ex2_ground_truth(spark, sf_dir):
    """Ground truth on the unsampled tables: performance and true g per model
    (one scan of the corpus, one aggregation)."""
    w = lexicon_model(spark, tuple(EXPERIMENT_CANDIDATE_WEIGHTS))
    labels, small = labels_table(spark, sf_dir)
    units, cands = corpus_unit_values(load_table(spark, sf_dir, "documents"), labels, ("lang", "source"), w, small, fold=F.lit(0))
    vals = units.select("kind", "n_known", F.posexplode_outer("xs").alias("cand_idx", "x"))
    agg = vals.groupBy("cand_idx").agg(
        mean_loss(F.col("kind") == "p").alias("perf"),
        F.avg(F.when(F.col("kind") == "g", F.col("x"))).alias("vmean"),
    )
    ids = F.array(*[F.lit(c) for c in cands])
    return agg.select(
        F.element_at(ids, F.col("cand_idx") + 1).alias("candidate_id"),
        round6("perf").alias("performance"),
        round6(F.col("vmean") - F.lit(VPROB.threshold)).alias("g"),
    )


def _wrap(select: str) -> str:
    return f"WITH r AS ({ex1_sql()}) {select}"


@register(
    "ex3_learning_curve",
    lambda: _wrap(
        """SELECT frac_id, data_frac, count(performance) AS n_passed, round(avg(performance) + 1e-9, 6) AS mean_performance,
        round(CASE WHEN count(performance) >= 2 THEN stddev_samp(performance) / sqrt(count(performance)) END, 6) AS se_performance
        FROM r GROUP BY frac_id, data_frac"""
    ),
)
def ex3_learning_curve(spark, sf_dir):
    lc = learning_curve(_experiment(spark, sf_dir))
    # performances have 6 places, so their mean can lie half-way; 1e-9 settles such ties the same way in any order of summation
    return lc.select("frac_id", "data_frac", "n_passed", round6(F.col("mean_performance") + 1e-9).alias("mean_performance"),
                     round6("se_performance").alias("se_performance"))


@register(
    "ex4_solution_rate",
    lambda: _wrap(
        """SELECT frac_id, data_frac, count(*) AS n_trials, round(avg(CAST(passed_safety AS DOUBLE)), 6) AS solution_rate,
        round(sqrt(avg(CAST(passed_safety AS DOUBLE)) * (1.0 - avg(CAST(passed_safety AS DOUBLE))) / count(*)), 6) AS se_solution_rate
        FROM r GROUP BY frac_id, data_frac"""
    ),
)
def ex4_solution_rate(spark, sf_dir):
    sr = solution_rate(_experiment(spark, sf_dir))
    return sr.select("frac_id", "data_frac", "n_trials", round6("solution_rate").alias("solution_rate"),
                     round6("se_solution_rate").alias("se_solution_rate"))


@register(
    "ex5_failure_rate",
    lambda: _wrap(
        """, x AS (SELECT *, CAST(passed_safety AND gvec[1] > 0 AS DOUBLE) AS bad FROM r)
        SELECT frac_id, data_frac, count(*) AS n_trials, round(avg(bad), 6) AS failure_rate,
        round(sqrt(avg(bad) * (1.0 - avg(bad)) / count(*)), 6) AS se_failure_rate FROM x GROUP BY frac_id, data_frac"""
    ).replace(") , x AS", "), x AS"),
)
def ex5_failure_rate(spark, sf_dir):
    fr = failure_rate(_experiment(spark, sf_dir))
    return fr.select("frac_id", "data_frac", "n_trials", round6("failure_rate").alias("failure_rate"),
                     round6("se_failure_rate").alias("se_failure_rate"))


@register(
    "ex6_abs_size",
    lambda: _wrap(
        f"""SELECT DISTINCT frac_id, data_frac, round(data_frac * (SELECT count(*) FROM ({O.PRIMARY})), 6) AS n_points FROM r"""
    ),
)
def ex6_abs_size(spark, sf_dir):
    """Fraction axis in absolute data points (fraction x labelled rows)."""
    res = _experiment(spark, sf_dir)
    total = primary_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    out = abs_size(res, F.lit(float(total)))
    return out.select("frac_id", "data_frac", round6("n_points").alias("n_points"))


def _pooled_frac(col):
    """The pooled file keeps 16 decimals of the fraction."""
    return F.floor(F.col(col) * F.lit(1e16)) / F.lit(1e16)


@register(
    "ex7_reconcile",
    lambda: _wrap(
        """SELECT round(data_frac, 10) AS frac_key, trial_i, trial_i <> 0 AS in_pooled, trial_i <> 2 AS in_trials,
        trial_i NOT IN (0, 2) AND (trial_i <> 1 OR performance IS NULL) AS match FROM r"""
    ),
)
def ex7_reconcile(spark, sf_dir):
    """A pooled file (fraction cut to 16 decimals) vs per-trial files, keyed on
    round(data_frac, 10). Three differences are planted: trial 0 isn't in the
    pooled file, trial 1 has another performance there, trial 2 has no trial file."""
    res = _experiment(spark, sf_dir).checkpoint()  # both copies read one materialised result
    pooled, cells = scratch_path(spark, "pooled"), scratch_path(spark, "cells")
    other = F.when(F.col("trial_i") == 1, F.col("performance") + 1).otherwise(F.col("performance"))
    write_pooled(res.filter("trial_i <> 0").withColumn("performance", other).withColumn("data_frac", _pooled_frac("data_frac")), pooled)
    write_trials(res.filter("trial_i <> 2"), cells)
    return reconcile(read_trials(spark, pooled, "pooled"), read_trials(spark, cells))


@register(
    "src5_decode_gvec",
    lambda: _wrap("SELECT frac_id, trial_i, gvec FROM r"),
)
def src5_decode_gvec(spark, sf_dir):
    """Experiment gvec written as text ('[-0.048933]', '[-inf]') and decoded back."""
    res = _experiment(spark, sf_dir)
    text = res.select("frac_id", "trial_i", encode_gvec(F.col("gvec")).alias("gvec_text"))
    return text.select("frac_id", "trial_i", decode_gvec(F.col("gvec_text")).alias("gvec"))


# ---------------------------------------------------------------- resampling and grid
BS_TRIALS = N_TRIALS


def _bs1_sql():
    return f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM ({O.PRIMARY})),
    n AS (SELECT count(*) AS n FROM p),
    d AS (SELECT r.id // n.n AS trial_i, r.id % n.n AS draw, n.n FROM n, range((SELECT {BS_TRIALS} * n FROM n)) r(id)),
    t AS (SELECT trial_i, {O.hash60(O.SEED_S, "'draw'", 'trial_i', 'draw')} % n AS idx FROM d)
    SELECT CAST(t.trial_i AS INTEGER) AS trial_i, p.doc_id, count(*) AS n_draws FROM t JOIN p ON t.idx = p.idx GROUP BY ALL"""


@register("bs1_bootstrap", _bs1_sql)
def bs1_bootstrap(spark, sf_dir):
    """Exact bootstrap: N draws with replacement per trial; draws per row."""
    draws = bootstrap(primary_table(spark, sf_dir).select("doc_id"), "doc_id", BS_TRIALS)
    return draws.groupBy("trial_i", "doc_id").agg(F.count(F.lit(1)).alias("n_draws"))


def _pw_sql(key: str) -> str:
    return _case_steps(O.uniform(O.SEED_S, "'boot'", "t.trial_i", key), POISSON)


@register(
    "bs2_poisson_weights",
    lambda: f"""SELECT CAST(t.trial_i AS INTEGER) AS trial_i, p.doc_id, {_pw_sql('p.doc_id')} AS w
    FROM ({O.PRIMARY}) p, range({BS_TRIALS}) t(trial_i)""",
)
def bs2_poisson_weights(spark, sf_dir):
    """Poisson(1) bootstrap weight per (row, trial): no index, no join."""
    return bootstrap_weights(primary_table(spark, sf_dir).select("doc_id"), "doc_id", BS_TRIALS).select("trial_i", "doc_id", "w")


@register(
    "bs3_group_bootstrap",
    lambda: f"""WITH g AS (SELECT DISTINCT group_id FROM ({O.GROUPS_LS}))
    SELECT CAST(t.trial_i AS INTEGER) AS trial_i, g.group_id, {_pw_sql('g.group_id')} AS w FROM g, range({BS_TRIALS}) t(trial_i)""",
)
def bs3_group_bootstrap(spark, sf_dir):
    """Whole groups resampled as units (all members share the weight)."""
    groups = document_groups(spark, sf_dir).select("group_id").distinct()
    return bootstrap_weights(groups, "group_id", BS_TRIALS).select("trial_i", "group_id", "w")


def _frac_values_sql():
    return ", ".join(f"({k}, CAST({f!r} AS DOUBLE))" for k, f in enumerate(FRACS))


@register(
    "gr1_frac_grid",
    lambda: f"""SELECT CAST(f.frac_id AS INTEGER) AS frac_id, f.data_frac,
    CAST(round(f.data_frac * n.n) AS BIGINT) AS n_target
    FROM (SELECT count(*) AS n FROM ({O.PRIMARY})) n, (VALUES {_frac_values_sql()}) f(frac_id, data_frac)""",
)
def gr1_frac_grid(spark, sf_dir):
    """logspace(-2.5, 0, 10) fractions with their target sizes on the labelled table."""
    n = primary_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    g = frac_grid(n)
    return g.select("frac_id", "data_frac", F.round(F.col("data_frac") * F.col("n")).cast("bigint").alias("n_target"))


@register(
    "gr2_trial_grid",
    lambda: f"""SELECT CAST(f.frac_id AS INTEGER) AS frac_id, f.data_frac, CAST(t.trial_i AS INTEGER) AS trial_i,
    CAST(round(f.data_frac * n.n) AS BIGINT) AS n_target
    FROM (SELECT count(*) AS n FROM ({O.PRIMARY})) n, (VALUES {_frac_values_sql()}) f(frac_id, data_frac), range({N_TRIALS}) t(trial_i)""",
)
def gr2_trial_grid(spark, sf_dir):
    """Every (fraction, trial) cell with its target size."""
    n = primary_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    g = trial_grid(n, N_TRIALS)
    return g.select("frac_id", "data_frac", "trial_i", F.round(F.col("data_frac") * F.col("n")).cast("bigint").alias("n_target"))


@register(
    "gr3_take_frac",
    lambda: f"""SELECT CAST(t.trial_i AS INTEGER) AS trial_i, p.doc_id,
    {_min_frac_sql(O.uniform(O.SEED_S, "'frac'", 't.trial_i', 'p.doc_id'))} AS min_frac_id
    FROM ({O.PRIMARY}) p, range({N_TRIALS}) t(trial_i)""",
)
def gr3_take_frac(spark, sf_dir):
    """Nested fractions: the smallest fraction of each trial that holds the row."""
    rows = primary_table(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(N_TRIALS - 1))).alias("trial_i"))
    return frac_ids(rows, "doc_id").select("trial_i", "doc_id", "min_frac_id")


@register(
    "gr4_pending_trials",
    lambda: _wrap(
        f"""SELECT CAST(f.frac_id AS INTEGER) AS frac_id, CAST(t.trial_i AS INTEGER) AS trial_i
        FROM (VALUES {_frac_values_sql()}) f(frac_id, data_frac), range({N_TRIALS}) t(trial_i)
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.frac_id = f.frac_id AND r.trial_i = t.trial_i AND r.trial_i < {N_TRIALS // 2})"""
    ),
)
def gr4_pending_trials(spark, sf_dir):
    """Grid cells without a recorded result: half of the trials are written,
    those that found no solution among them, and read back as done."""
    res = _experiment(spark, sf_dir)
    grid = trial_grid(spark.range(1).select(), N_TRIALS).select("frac_id", "trial_i")
    path = scratch_path(spark, "recorded")
    res.filter(F.col("trial_i") < N_TRIALS // 2).select("frac_id", "trial_i", "passed_safety").write.parquet(path)
    return pending_trials(grid, spark.read.parquet(path))
