"""The experiment: every (data fraction, trial) cell in one plan.

For each trial the data are resampled with replacement, cut to a fraction,
split into candidate and safety parts; a model is selected on the candidate
part (lowest loss whose predicted safety bound is <= 0) and accepted only if
the safety part confirms the bound. Accepted models report their loss on the
full labelled table and their true g on the full group table.

Plan (no per-cell loop, no copies of the data):

1. score every labelled row and every group once for all K candidates:
   per-row log loss array, per-group VPROB array (``unit_values``);
2. per (unit, trial) one md5 gives three uniforms: part (safety share),
   Poisson(1) weight w, and the smallest fraction containing the unit;
3. one aggregation to weighted moments (sum w, sum wx, sum wx^2, distinct
   units) per (trial, kind, part, fraction, candidate) — map-side combined,
   so the shuffle carries a few thousand rows whatever the data size; a corpus's labelled rows are
   summed into their cells where they are scored (``corpus_moments``);
4. a running sum over fractions on that small frame gives every nested
   fraction; bounds, selection and the safety test are Column arithmetic.

Trial -1 is the unsampled table (weight 1, everything in one part): the
ground truth rides in the same aggregation.

Weighted copies are not independent units: the t bound uses n = sum of
weights, and a part needs at least ``min_units`` distinct units, otherwise
two copies of one group would give sd = 0 and a spurious pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..functions.hashing import hash_key, hex_uniform
from ..functions.scalar import log_loss, round6, sigmoid
from ..functions.stats import double_array, t_quantile
from ..operators.constraints import group_measures, is_mergeable, measure
from ..operators.measures import metric
from ..operators.resample import min_frac_id, poisson_weight
from ..operators.score import candidate_ids, score_arrays

MOMENTS_BROADCAST_MAX_ROWS = 1_000_000
PARTS = ("candidate", "safety")


def block_kinds(kind: str, n: int) -> list[str]:
    """Names of the ``n`` values that units of a kind have for each candidate: ``g, g1, g2, ...``"""
    return [kind + (str(i) if i else "") for i in range(n)]


def row_terms(cfg: ExperimentConfig) -> tuple[list, int]:
    """Functions of (label, probability): the objective's terms, then the performance metric's where it is another;
    and the place of the latter."""
    objective, performance = metric(cfg.objective), metric(cfg.performance)
    both = [objective] if objective == performance else [objective, performance]
    size = len(objective.terms(F.lit(0), F.lit(0.0)))
    return [m.terms for m in both], size if len(both) > 1 else 0


def terms_of(makers: list, y: Column, p: Column) -> list[Column]:
    return [t for make in makers for t in make(y, p)]


def values_of(makers: list, y: Column, logits: Column, k: int) -> Column:
    """The array of all terms of a labelled row, each for every candidate in turn."""
    each = [terms_of(makers, y, sigmoid(F.element_at(logits, i + 1))) for i in range(k)]
    return F.array(*[each[i][t].cast("double") for t in range(len(each[0])) for i in range(k)])


LOG_LOSS = ([lambda y, p: [log_loss(y, p)]], 0)


def unit_values(primary: DataFrame, groups: DataFrame, weights: DataFrame, measure_name="VPROB", terms: tuple = LOG_LOSS):
    """``(kind, unit, xs)``: per labelled row the per-candidate log loss (or each of ``terms``), per
    group the per-candidate measure (NULL where undefined), for each of several measure names in turn. Returns
    ``(frame, candidate_ids)``. ``primary`` is raw ``(doc_id, label, text)``
    or pre-scored ``(doc_id, label, logits)`` (``labelled_logits``)."""
    names = [measure_name] if isinstance(measure_name, str) else list(measure_name)
    if "logits" in primary.columns:
        p_arr = primary.select("doc_id", "label", "logits")
        cands = candidate_ids(weights)
    else:
        p_arr, cands = score_arrays(primary.select("doc_id", "label", "text"), weights, key_cols=["doc_id"])
    k = len(cands)
    p_units = p_arr.select(
        F.lit("p").alias("kind"), F.col("doc_id").alias("unit"), values_of(terms[0], F.col("label"), F.col("logits"), k).alias("xs")
    )
    g_arr, _ = score_arrays(groups.select("group_id", "pos", "text"), weights, key_cols=["group_id", "pos"])
    members = g_arr.select(F.lit("g").alias("kind"), F.col("group_id").alias("unit"), "logits")
    return p_units.unionByName(group_values(members, k, names)), cands


def group_values(members: DataFrame, k: int, names: list) -> DataFrame:
    """``(kind, unit, xs)`` from members ``(kind, unit, logits)``: Spark's own aggregates in one ``groupBy``, functions
    of the user's (``register_mergeable``) from partial states merged per group and joined by group."""
    own, theirs = [n for n in names if not is_mergeable(n)], [n for n in names if is_mergeable(n)]
    at = {n: j for j, n in enumerate(own)}
    aggs = [measure(n)(sigmoid(F.element_at("logits", i + 1))).alias(f"_v{j}_{i}") for j, n in enumerate(own) for i in range(k)]
    per_unit = members.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("_n"), *aggs)
    for j, n in enumerate(theirs):
        long = members.select("kind", "unit", F.posexplode_outer("logits").alias("_c", "logit"))
        found = group_measures(long, [n], group_col="unit", by=("kind", "_c"))
        wide = found.groupBy("kind", "unit").agg(*[F.max(F.when(F.col("_c") == i, F.col("value"))).alias(f"_v{len(own) + j}_{i}") for i in range(k)])
        per_unit = per_unit.join(wide, ["kind", "unit"], "left")
        at[n] = len(own) + j
    return per_unit.select("kind", "unit", F.array(*[F.col(f"_v{at[n]}_{i}").cast("double") for n in names for i in range(k)]).alias("xs"))


def corpus_unit_values(
    docs: DataFrame,
    labels: DataFrame,
    group_cols,
    weights: DataFrame,
    labels_broadcast: bool | None = None,
    groupings: dict | None = None,
    measures: tuple = ("VPROB",),
    fold=None,
    terms: tuple = LOG_LOSS,
):
    """``unit_values`` for the common case where the labelled rows and the
    group members are the same corpus: one scan, one scoring of every text.

    Each document is scored in place and emits one group row per grouping (``kind`` = grouping name, ``'g'`` by
    default, ``unit`` = group id) and one row that meets its label rows (broadcast when ``labels_broadcast``, else a
    shuffle of ``(doc_id, logits)`` rows). A document labelled several times has a label row for each, but is one
    member of its groups. Group measures are combined map-side, so
    a hot group costs one partial per task. ``xs`` of a group holds the candidates' values of each of ``measures`` in
    turn, that of a label row those of each of ``terms``. ``groupings`` maps kind names to grouping columns and replaces
    ``group_cols``. ``labels_broadcast=None`` decides from the checked size of
    ``labels``.

    ``fold``: an integer Column over ``doc_id``, or a function of the ``doc_id`` Column giving an array of
    ``(unit, w)`` structs. The label rows are then summed map-side, each ``w`` times, into one unit for each of its values
    (``xs`` the summed terms, ``n`` the label rows, ``n_known`` those with a label, ``n_units`` the documents' rows), so the shuffle
    holds group-sized rows only. Without it label rows stay as they are (``unit`` = doc_id), from a second
    scan. Returns ``(frame, candidate_ids)``."""
    from ..sources.standins import group_id_of, labels_fit_broadcast

    if labels_broadcast is None:
        labels_broadcast = labels_fit_broadcast(labels)

    groupings = dict(groupings or {"g": tuple(group_cols)})
    gid_cols = {kind: f"_gid{i}" for i, kind in enumerate(groupings)}
    scored, cands = score_arrays(
        docs.select("doc_id", "text", *[group_id_of(*cols).alias(gid_cols[k]) for k, cols in groupings.items()]),
        weights,
        key_cols=["doc_id"],
    )
    if any(is_mergeable(m) for m in measures):
        scored = scored.checkpoint()  # ids and logits, no texts: measures in Python read the members once more
    k = len(cands)
    entry = lambda kind, unit: F.struct(F.lit(kind).alias("kind"), unit.cast("long").alias("unit"))
    of_groups = [entry(kind, F.col(c)) for kind, c in gid_cols.items()]
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("_y"), F.lit("p").alias("_kind"))
    lab = F.broadcast(lab) if labels_broadcast else lab
    if fold is None:
        rows = scored.join(lab.drop("_kind"), F.col("doc_id") == F.col("_id"))
        p_units = rows.select(F.lit("p").alias("kind"), F.col("doc_id").alias("unit"), values_of(terms[0], F.col("_y"), F.col("logits"), k).alias("xs"))
        members = scored.select("logits", F.explode(F.array(*of_groups)).alias("_u")).select("_u.*", "logits")
        return p_units.unionByName(group_values(members, k, list(measures))), cands

    rows = scored.select("doc_id", "logits", F.explode(F.array(*of_groups, entry("p", F.col("doc_id")))).alias("_u"))
    # rows of groups have a key of their own: spread in a shuffled join, and no label meets them
    met = rows.join(lab, (F.col("doc_id") == F.col("_id")) & (F.col("_u.kind") == F.col("_kind")), "left")
    is_p = F.col("_u.kind") == "p"
    met = met.where(~is_p | F.col("_id").isNotNull())
    if isinstance(fold, Column):
        cells = F.array(F.struct(fold.cast("long").alias("unit"), F.lit(1).alias("w")))
    else:
        cells = fold(F.col("doc_id"))
    own = F.array(F.struct(F.col("_u.unit").alias("unit"), F.lit(1).alias("w")))
    dealt = met.select(F.col("_u.kind").alias("kind"), "logits", "_y", F.explode(F.when(is_p, cells).otherwise(own)).alias("_c"))
    is_p, w, y = F.col("kind") == "p", F.col("_c.w"), F.col("_y")
    own_measures = [m for m in measures if not is_mergeable(m)]
    aggs, n_terms = [], 0
    for i in range(k):
        prob = sigmoid(F.element_at("logits", i + 1))
        aggs += [measure(m)(F.when(~is_p, prob)).alias(f"_v{j}_{i}") for j, m in enumerate(own_measures)]
        each = terms_of(terms[0], y, prob)
        n_terms = len(each)
        aggs += [F.sum(F.when(is_p, w * x)).alias(f"_l{t}_{i}") for t, x in enumerate(each)]
    aggs += [
        F.coalesce(F.sum(F.when(is_p, w)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(is_p & y.isNotNull(), w)), F.lit(0)).alias("n_known"),
        F.count(F.when(is_p & y.isNotNull(), F.lit(1))).alias("n_units"),
    ]
    per_unit = dealt.groupBy("kind", F.col("_c.unit").alias("unit")).agg(*aggs)
    of_rows = F.array(*[F.col(f"_l{t}_{i}") for t in range(n_terms) for i in range(k)])
    if len(own_measures) == len(measures):
        of_units = F.array(*[F.col(f"_v{j}_{i}").cast("double") for j in range(len(measures)) for i in range(k)])
    else:
        members = scored.select("logits", F.explode(F.array(*of_groups)).alias("_u")).select("_u.*", "logits")
        per_unit = per_unit.join(group_values(members, k, list(measures)), ["kind", "unit"], "left")
        of_units = F.col("xs")
    xs = F.when(F.col("kind") == "p", of_rows).otherwise(of_units)
    return per_unit.select("kind", "unit", xs.alias("xs"), "n", "n_known", "n_units"), cands


def mean_loss(of_p: Column) -> Column:
    """Mean loss over folded label rows ``(x, n_known)`` for which ``of_p`` holds."""
    return F.sum(F.when(of_p, F.col("x"))) / F.sum(F.when(of_p & (F.col("n_known") > 0), F.col("n_known")))


def corpus_split_stats(
    docs: DataFrame, labels: DataFrame, groupings: dict, weights: DataFrame, labels_broadcast: bool | None = None, frac_safety: float | None = None
):
    """Per (grouping, candidate): loss on the candidate part of the labelled
    rows and the VPROB summary on the candidate and safety parts of the
    groups — every grouping from one scan and one aggregation.

    ``(grouping, candidate_id, loss, n, mean, sd, n_safety, mean_safety, sd_safety)``."""
    from ..config import FRAC_DATA_IN_SAFETY
    from ..operators.prep import safety_part

    frac = FRAC_DATA_IN_SAFETY if frac_safety is None else frac_safety
    fold = F.when(safety_part(F.col("doc_id"), frac) == "candidate", 0).otherwise(1)
    units, cands = corpus_unit_values(docs, labels, None, weights, labels_broadcast, groupings, fold=fold)
    of_row = F.when(F.col("unit") == 0, "candidate").otherwise("safety")
    part = F.when(F.col("kind") == "p", of_row).otherwise(safety_part(F.col("unit"), frac))
    vals = units.select("kind", part.alias("part"), "n_known", F.posexplode_outer("xs").alias("cand_idx", "x"))
    kind, prt, x = F.col("kind"), F.col("part"), F.col("x")
    aggs = [mean_loss((kind == "p") & (prt == "candidate")).alias("loss")]
    names = list(groupings)
    for i, name in enumerate(names):
        for p_name, sfx in (("candidate", ""), ("safety", "_safety")):
            sel = F.when((kind == name) & (prt == p_name), x)
            aggs += [F.count(sel).alias(f"n{sfx}_{i}"), F.avg(sel).alias(f"mean{sfx}_{i}"), F.stddev_samp(sel).alias(f"sd{sfx}_{i}")]
    # one aggregation (one consumer of the units, so one scan), then one row per grouping
    per_cand = vals.groupBy("cand_idx").agg(*aggs)
    cols = ["n", "mean", "sd", "n_safety", "mean_safety", "sd_safety"]
    per_grouping = F.array(
        *[F.struct(F.lit(name).alias("grouping"), *[F.col(f"{c}_{i}").alias(c) for c in cols]) for i, name in enumerate(names)]
    )
    ids = F.array(*[F.lit(c) for c in cands])
    out = per_cand.select("cand_idx", "loss", F.explode(per_grouping).alias("_g"))
    return out.select(
        "_g.grouping", F.element_at(ids, F.col("cand_idx") + 1).alias("candidate_id"), "loss", *[f"_g.{c}" for c in cols]
    )


def drawn_cells(cfg: ExperimentConfig, kind: Column, unit: Column, pending: dict | None = None) -> Column:
    """The trials that draw a unit: an array of ``(trial_i, part, frac_id, w)``, part 0 (candidate), 1 (safety)
    or 2 (all); trial -1 is the unsampled table. ``pending`` (trial -> its largest fraction that is still to be computed) leaves out
    trials and fractions that no such cell needs."""
    last = len(cfg.fracs) - 1
    trials = {t: last for t in range(cfg.n_trials)} if pending is None else pending

    def cell(t: Column) -> Column:
        h = F.md5(hash_key(F.lit(cfg.seed), F.lit("trial"), t, kind, unit))
        u = [hex_uniform(h, i) for i in range(3)]
        gt = t < 0
        return F.struct(
            t.alias("trial_i"),
            F.when(gt, F.lit(2)).when(u[0] < F.lit(cfg.frac_safety), F.lit(1)).otherwise(F.lit(0)).alias("part"),
            F.when(gt, F.lit(0)).otherwise(min_frac_id(u[2], list(cfg.fracs))).alias("frac_id"),
            F.when(gt, F.lit(1)).otherwise(poisson_weight(u[1])).alias("w"),
        )

    wanted = F.create_map(F.lit(-1), F.lit(0), *[F.lit(x) for t in sorted(trials) for x in (t, trials[t])])
    every = F.transform(F.array(F.lit(-1), *[F.lit(t) for t in sorted(trials)]), cell)
    return F.filter(every, lambda c: (c["w"] > 0) & (c["frac_id"] <= F.element_at(wanted, c["trial_i"])))


PART_NAMES = (*PARTS, "all")


def experiment_moments(units: DataFrame, cfg: ExperimentConfig, k: int | None = None, blocks: int | None = None, pending: dict | None = None) -> DataFrame:
    """Weighted moments per (trial_i, kind, part, frac_id, cand_idx); trial -1
    is the unsampled table. ``xs`` holds ``blocks`` values for each of ``k`` candidates (by default those that the
    configuration's measures and metrics need); the kind of block i is named as :func:`block_kinds` says.

    Weight, part and fraction belong to the (unit, trial), not to the
    candidate, so all values are summed as separate columns of one row
    (K times fewer rows through the aggregation); only the small aggregated
    frame is unpivoted into candidate rows."""
    if blocks is None:
        blocks = max(len(cfg.measures), n_row_terms(cfg))
    if k is None:
        k = units.select(F.size("xs").alias("k")).agg(F.max("k")).first()[0] or 0
    drawn = units.select("kind", "xs", F.explode(drawn_cells(cfg, F.col("kind"), F.col("unit"), pending)).alias("_c")).select("kind", "xs", "_c.*")
    w = F.col("w")
    aggs = []
    for c in range(k * blocks):
        x = F.get("xs", F.lit(c))
        seen = x.isNotNull()
        aggs += [
            F.sum(F.when(seen, w)).alias(f"sw{c}"),
            F.sum(w * x).alias(f"swx{c}"),
            F.sum(w * x * x).alias(f"swx2{c}"),
            F.count(x).alias(f"nu{c}"),
        ]
    wide = drawn.groupBy("trial_i", "kind", "part", "frac_id").agg(*aggs)
    return long_moments(wide, k, blocks)


def n_row_terms(cfg: ExperimentConfig) -> int:
    return len(terms_of(row_terms(cfg)[0], F.lit(0), F.lit(0.0)))


def long_moments(wide: DataFrame, k: int, blocks: int) -> DataFrame:
    """Moment columns ``sw<c>, swx<c>, swx2<c>, nu<c>`` of a small frame as a row for each candidate and kind of value."""
    per_cand = F.array(
        *[
            F.struct(
                F.coalesce(F.col(f"sw{c}"), F.lit(0)).cast("bigint").alias("sw"),
                F.col(f"swx{c}").alias("swx"),
                F.col(f"swx2{c}").alias("swx2"),
                F.col(f"nu{c}").alias("nu"),
            )
            for c in range(k * blocks)
        ]
    )
    part = F.element_at(F.array(*[F.lit(x) for x in PART_NAMES]), F.col("part") + 1)
    long = wide.select("trial_i", "kind", part.alias("part"), "frac_id", F.posexplode_outer(per_cand).alias("_at", "_m"))
    block = F.floor(F.col("_at") / F.lit(k)).cast("string")
    named = long.withColumn("kind", F.concat("kind", F.when(block == "0", F.lit("")).otherwise(block)))
    return named.filter(F.col("_m.nu") > 0).select(
        "trial_i", "kind", "part", "frac_id", (F.col("_at") % F.lit(k)).alias("cand_idx"), "_m.sw", "_m.swx", "_m.swx2", "_m.nu"
    )


def corpus_moments(docs: DataFrame, labels: DataFrame, group_cols, weights: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), labels_broadcast: bool | None = None, pending: dict | None = None):
    """:func:`experiment_moments` of a corpus whose label rows are summed map-side into their (trial, part,
    fraction) cells: the largest shuffle holds a row for each group and cell, none for a document. Returns ``(moments, candidate_ids)``."""
    parts, fracs = len(PART_NAMES), len(cfg.fracs)

    def cells(doc_id: Column) -> Column:
        code = lambda c: ((c["trial_i"] + 1) * parts + c["part"]) * fracs + c["frac_id"]
        return F.transform(drawn_cells(cfg, F.lit("p"), doc_id, pending), lambda c: F.struct(code(c).cast("long").alias("unit"), c["w"].alias("w")))

    makers = row_terms(cfg)
    units, cands = corpus_unit_values(docs, labels, group_cols, weights, labels_broadcast, measures=tuple(cfg.measures), fold=cells, terms=makers)
    k, blocks = len(cands), max(len(cfg.measures), n_row_terms(cfg))
    is_p, code = F.col("kind") == "p", F.col("unit")
    # a cell of label rows is drawn as it is, a group by the hash of its id
    cell = F.struct(
        (F.floor(code / F.lit(parts * fracs)) - 1).cast("int").alias("trial_i"),
        (F.floor(code / F.lit(fracs)) % parts).cast("int").alias("part"),
        (code % fracs).cast("int").alias("frac_id"),
        F.lit(1).alias("w"),
    )
    drawn = F.when(is_p, F.array(cell)).otherwise(drawn_cells(cfg, F.col("kind"), code, pending))
    rows = units.select("kind", "xs", "n_known", "n_units", F.explode(drawn).alias("_c")).select("kind", "xs", "n_known", "n_units", "_c.*")
    w, aggs = F.col("w"), []
    for c in range(k * blocks):
        x = F.get("xs", F.lit(c))
        seen = x.isNotNull()
        aggs += [
            F.sum(F.when(seen, F.when(is_p, F.col("n_known")).otherwise(w))).alias(f"sw{c}"),
            F.sum(w * x).alias(f"swx{c}"),
            F.sum(F.when(~is_p, w * x * x)).alias(f"swx2{c}"),
            F.sum(F.when(seen, F.when(is_p, F.col("n_units")).otherwise(F.lit(1)))).alias(f"nu{c}"),
        ]
    return long_moments(rows.groupBy("trial_i", "kind", "part", "frac_id").agg(*aggs), k, blocks), cands


def _grid(spark: SparkSession, cfg: ExperimentConfig, k: int, kinds: list) -> DataFrame:
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    arr = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    g = spark.range(1).select(seq(cfg.n_trials).alias("trial_i"))
    g = g.select("*", arr(kinds).alias("kind"))
    g = g.select("*", arr(PARTS).alias("part"))
    g = g.select("*", seq(len(cfg.fracs)).alias("frac_id"))
    return g.select("*", seq(k).alias("cand_idx"))


def _sd(n: Column, s1: Column, s2: Column) -> Column:
    return F.when(n >= 2, F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))))


def run_experiment(primary: DataFrame, groups: DataFrame, weights: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """One result row per (frac_id, trial_i):
    ``frac_id, data_frac, trial_i, candidate_id, performance, passed_safety, gvec``. A solution must be predicted and
    then found safe under every constraint of the configuration; ``gvec`` has the true g of each."""
    units, cands = unit_values(primary, groups, weights, cfg.measures, row_terms(cfg))
    return results_from_units(units, cands, cfg)


def run_corpus_experiment(docs: DataFrame, labels: DataFrame, group_cols, weights: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), labels_broadcast: bool | None = None) -> DataFrame:
    """:func:`run_experiment` where labelled rows and group members are one corpus: one scan, one scoring of every text."""
    return results_from_moments(*corpus_moments(docs, labels, group_cols, weights, cfg, labels_broadcast), cfg)


def results_from_units(units: DataFrame, cands, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    return results_from_moments(experiment_moments(units, cfg, len(cands)), cands, cfg)


def cell_bounds(mom: DataFrame, k: int, cfg: ExperimentConfig) -> DataFrame:
    """Per (trial_i, frac_id, cand_idx): candidate-part loss, and for each constraint i the predicted bound ``pred<i>``,
    the safety bound ``safe<i>`` and distinct-unit counts of both parts ``nu_c<i>, nu_s<i>``; the ground truth of the candidate
    (``perf``, and ``vmean<i>`` of each constraint's evaluation).

    ``mom`` is read once: the unsampled rows (trial -1) travel in the same
    small frame and are spread to every cell by a window over the candidate."""
    spark = mom.sparkSession
    n_terms = n_row_terms(cfg)
    p_kinds, g_kinds = block_kinds("p", n_terms), block_kinds("g", len(cfg.measures))
    kinds = p_kinds + g_kinds

    # every key (plus the ground-truth keys), then running sums over fractions
    keys = ["trial_i", "kind", "part", "frac_id", "cand_idx"]
    truth_keys = spark.range(1).select(
        F.lit(-1).alias("trial_i"),
        F.explode(F.array(*[F.lit(x) for x in kinds])).alias("kind"),
    ).select("*", F.lit("all").alias("part"), F.lit(0).alias("frac_id"))
    truth_keys = truth_keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cand_idx"))
    grid = _grid(spark, cfg, k, kinds).unionByName(truth_keys)
    cum_w = Window.partitionBy("trial_i", "kind", "part", "cand_idx").orderBy("frac_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # moments have at most (trials + 1) x kinds x 3 parts x fractions x K rows,
    # fixed by the configuration; broadcast them while that bound is small
    bound = (cfg.n_trials + 1) * len(kinds) * 3 * len(cfg.fracs) * k
    moments = F.broadcast(mom) if bound <= MOMENTS_BROADCAST_MAX_ROWS else mom
    cum = grid.join(moments, keys, "left").select(
        *keys, *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(cum_w).alias(m) for m in ("sw", "swx", "swx2", "nu")]
    )
    per_cand = Window.partitionBy("cand_idx")
    gt = F.col("trial_i") < 0
    mean = F.when(F.col("sw") > 0, F.col("swx") / F.col("sw"))
    at = {m: g for m, g in zip(cfg.measures, g_kinds, strict=True)}
    objective, performance, first = metric(cfg.objective), metric(cfg.performance), row_terms(cfg)[1]
    true_terms = [F.max(F.when(gt & (F.col("kind") == kind), mean)).over(per_cand) for kind in p_kinds[first:]]
    truth = [performance.finish(true_terms).alias("perf")]
    truth += [F.max(F.when(gt & (F.col("kind") == at[m]), mean)).over(per_cand).alias(f"vmean{i}") for i, m in enumerate(cfg.evaluation_measures)]
    cum = cum.select("*", *truth).filter(~gt)

    def pick(kind, part, expr):
        return F.max(F.when((F.col("kind") == kind) & (F.col("part") == part), expr))

    n_objective = n_terms if first == 0 else first
    cs = list(enumerate(cfg.all_constraints))
    cell = cum.groupBy("trial_i", "frac_id", "cand_idx").agg(
        *[pick(kind, "candidate", mean).alias(f"_o{t}") for t, kind in enumerate(p_kinds[:n_objective])],
        *[
            pick(at[c.measure], part, F.col(m)).alias(f"{m}_{part[0]}{i}")
            for i, c in cs
            for part in PARTS
            for m in ("sw", "swx", "swx2", "nu")
        ],
        F.max("perf").alias("perf"),
        *[F.max(f"vmean{i}").alias(f"vmean{i}") for i, _ in cs],
    )

    def bounds(i, c):
        n_c, n_s = F.col(f"sw_c{i}"), F.col(f"sw_s{i}")
        mean_c = F.when(n_c > 0, F.col(f"swx_c{i}") / n_c)
        mean_s = F.when(n_s > 0, F.col(f"swx_s{i}") / n_s)
        sd_c = _sd(n_c, F.col(f"swx_c{i}"), F.col(f"swx2_c{i}"))
        sd_s = _sd(n_s, F.col(f"swx_s{i}"), F.col(f"swx2_s{i}"))
        t_s = t_quantile(n_s - 1, 1.0 - c.delta)
        sign, thr = F.lit(c.sign), F.lit(c.sign * c.threshold)
        pred = F.when(n_s >= 2, sign * mean_c + F.lit(2.0) * sd_c / F.sqrt(n_s.cast("double")) * t_s - thr)
        safe = F.when(n_s >= 2, sign * mean_s + sd_s / F.sqrt(n_s.cast("double")) * t_s - thr)
        return [pred.alias(f"pred{i}"), safe.alias(f"safe{i}"), F.col(f"nu_c{i}"), F.col(f"nu_s{i}"), F.col(f"vmean{i}")]

    return cell.select(
        "trial_i",
        "frac_id",
        "cand_idx",
        objective.finish([F.col(f"_o{t}") for t in range(n_objective)]).alias("loss_c"),
        "perf",
        *[x for i, c in cs for x in bounds(i, c)],
    )


def results_from_moments(mom: DataFrame, cands, cfg: ExperimentConfig) -> DataFrame:
    cs = list(enumerate(cfg.all_constraints))
    bounds = cell_bounds(mom, len(cands), cfg)
    every = lambda of: reduce(lambda x, y: x & y, [of(i) for i, _ in cs])
    feasible = every(lambda i: F.coalesce(F.col(f"pred{i}") <= 0, F.lit(False)) & (F.col(f"nu_c{i}") >= cfg.min_units)) & F.col("loss_c").isNotNull()
    kept = ["cand_idx", "perf", *[f"{x}{i}" for i, _ in cs for x in ("safe", "nu_s", "vmean")]]
    chosen = bounds.groupBy("trial_i", "frac_id").agg(
        F.min_by(
            F.when(feasible, F.struct(*kept)),
            F.when(feasible, F.struct("loss_c", "cand_idx")),
        ).alias("_b")
    )
    passed = every(
        lambda i: F.coalesce(F.col(f"_b.safe{i}") <= 0, F.lit(False)) & F.coalesce(F.col(f"_b.nu_s{i}") >= cfg.min_units, F.lit(False))
    )
    ids = F.array(*[F.lit(x) for x in cands])
    fracs = double_array(cfg.fracs)
    res = chosen.select(
        "frac_id",
        "trial_i",
        F.col("_b.cand_idx").alias("cand_idx"),
        F.col("_b.perf").alias("perf"),
        F.array(*[round6(F.lit(c.sign) * F.col(f"_b.vmean{i}") - F.lit(c.sign * c.threshold)) for i, c in cs]).alias("g_true"),
        passed.alias("passed_safety"),
    )
    return res.select(
        "frac_id",
        F.element_at(fracs, F.col("frac_id") + 1).alias("data_frac"),
        "trial_i",
        # explicit NULL guard: element_at on a literal array with a NULL index
        # has returned a stale value in generated code
        F.when(F.col("cand_idx").isNotNull(), F.element_at(ids, F.col("cand_idx") + 1)).alias("candidate_id"),
        F.when(F.col("passed_safety"), round6("perf")).alias("performance"),
        "passed_safety",
        F.when(F.col("passed_safety"), F.col("g_true")).otherwise(F.array(*[F.lit(float("-inf")) for _ in cs])).alias("gvec"),
    )


# ---------------------------------------------------------------- reporting (EX3-EX7)
def learning_curve(results: DataFrame) -> DataFrame:
    """Mean performance and standard error per fraction, passed trials only."""
    perf = F.col("performance")
    return results.groupBy("frac_id", "data_frac").agg(
        F.count(perf).alias("n_passed"),
        F.avg(perf).alias("mean_performance"),
        F.when(F.count(perf) >= 2, F.stddev_samp(perf) / F.sqrt(F.count(perf))).alias("se_performance"),
    )


def _rate(flag: Column, name: str):
    r = F.avg(flag.cast("double"))
    n = F.count(F.lit(1))
    return [r.alias(name), F.sqrt(r * (F.lit(1.0) - r) / n).alias(f"se_{name}")]


def solution_rate(results: DataFrame) -> DataFrame:
    """Share of trials that returned a model which passed the safety test."""
    return results.groupBy("frac_id", "data_frac").agg(F.count(F.lit(1)).alias("n_trials"), *_rate(F.col("passed_safety"), "solution_rate"))


def failure_rate(results: DataFrame) -> DataFrame:
    """Share of trials that passed yet violate the constraint on the full data."""
    bad = F.col("passed_safety") & F.exists("gvec", lambda g: g > 0)
    return results.groupBy("frac_id", "data_frac").agg(F.count(F.lit(1)).alias("n_trials"), *_rate(bad, "failure_rate"))


def abs_size(results: DataFrame, total: Column) -> DataFrame:
    """Fraction -> absolute number of data points (frac x total size)."""
    return results.select("frac_id", "data_frac").distinct().select(
        "frac_id", "data_frac", (F.col("data_frac") * total).alias("n_points")
    )


def reconcile(pooled: DataFrame, trials: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Match pooled rows to per-trial rows on (round(data_frac, 10), trial_i);
    raw doubles are never compared as keys."""
    key = lambda df, p: df.select(
        F.round("data_frac", 10).alias("frac_key"), "trial_i",
        F.col("performance").alias(f"perf_{p}"), F.col("passed_safety").alias(f"passed_{p}"), F.col("gvec").alias(f"gvec_{p}"),
    )
    j = key(pooled, "a").join(key(trials, "b"), ["frac_key", "trial_i"], "full_outer")
    same_perf = (F.col("perf_a").isNull() & F.col("perf_b").isNull()) | (F.abs(F.col("perf_a") - F.col("perf_b")) <= tol)
    return j.select(
        "frac_key",
        "trial_i",
        F.col("passed_a").isNotNull().alias("in_pooled"),
        F.col("passed_b").isNotNull().alias("in_trials"),
        F.coalesce(same_perf & (F.col("passed_a") == F.col("passed_b")) & (F.col("gvec_a") == F.col("gvec_b")), F.lit(False)).alias("match"),
    )


def pending_cells(spark: SparkSession, cells_dir: str, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """``(frac_id, trial_i)`` cells of the grid that ``cells_dir`` doesn't hold; all of them where it isn't there yet."""
    from pyspark.errors import AnalysisException

    from ..operators.resample import pending_trials, trial_grid
    from ..sources.results import read_trials

    grid = trial_grid(spark.range(1).select(), cfg.n_trials, list(cfg.fracs)).select(
        F.col("frac_id").cast("int").alias("frac_id"), F.col("trial_i").cast("int").alias("trial_i")
    )
    try:
        done = read_trials(spark, cells_dir).select("frac_id", "trial_i")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return grid
    return pending_trials(grid, done)


def resume_experiment(units: DataFrame, cands, cells_dir: str, cfg: ExperimentConfig = ExperimentConfig()) -> int:
    """Compute and record the experiment cells that ``cells_dir`` does not hold yet.

    Recorded cells are read back and the pending (frac_id, trial_i) cells are the
    grid minus those (anti join). Only trials with a pending cell are drawn, and of each only the units of its largest pending
    fraction (fractions are nested); one output unit per pending cell is appended, so an interrupted grid resumes without
    repeating or duplicating cells. Returns the number of cells written."""
    from ..sources.results import write_trials

    pending = pending_cells(units.sparkSession, cells_dir, cfg).checkpoint()  # read before cells are added
    largest = {r["trial_i"]: r["f"] for r in pending.groupBy("trial_i").agg(F.max("frac_id").alias("f")).collect()}  # n_trials rows
    if not largest:
        return 0
    mom = experiment_moments(units, cfg, len(cands), pending=largest)
    todo = results_from_moments(mom, cands, cfg).join(F.broadcast(pending), ["frac_id", "trial_i"], "left_semi")
    todo = todo.checkpoint()  # computed once, counted and written from the same copy
    write_trials(todo, cells_dir, mode="append")
    return todo.count()
