"""Registered queries: scoring (SC1-7), measures (AGG1-5), constraints
(CN1-8), selection and gradients (TRN1-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LEXICON, PRIMARY_BATCH_SIZE, SAFETY_BATCH_SIZE, VPROB, Constraint
from ..functions.scalar import log_loss, positive_logit, round6, sigmoid
from ..operators.constraints import (
    ENTROPIC_T,
    bind,
    constraint_bounds,
    evaluate_bindings,
    g_value,
    group_measures,
    passes,
    predicted_bound,
    safety_test,
)
from ..operators.measures import cross_entropy, perf_eval, summarise, summarise_batched, vprob
from ..operators.prep import dense_index, order_key, safety_part
from ..operators.score import (
    class_logits,
    lexicon_model,
    lexicon_scorer,
    pad_batches,
    score_terms,
    score_with,
)
from ..operators.train import loss_gradient_from_hits, select_candidate, variance_gradient
from ..session import load_table
from ..sources.standins import conversation_groups, document_groups, labelled_hits, labelled_logits, labels_table, primary_table
from .experiment import corpus_split_stats
from . import oracle as O
from .catalog import register

W = O.weights_values()
W0 = O.weights_values((1.0,))
P_SCORED = O.scored(O.PRIMARY, ["doc_id"], ["label"], W)
MAX_TOKENS = 512
VRANGE = Constraint("VRANGE <= 0.5", "VRANGE", "<=", 0.5, 0.1)
VPROB_FLOOR = Constraint("VPROB >= 0.001", "VPROB", ">=", 0.001, 0.05)
CONSTRAINTS = [VPROB, VRANGE, VPROB_FLOOR]
GROUPINGS = {"lang_source": ("lang", "source"), "source": ("source",)}
GROUPINGS_SQL = {"lang_source": O.GROUPS_LS, "source": O.GROUPS_SRC}


def _scored_primary(spark, sf_dir, weights=None):
    w = weights if weights is not None else lexicon_model(spark)
    return labelled_logits(spark, sf_dir, w)[0]


def _members(spark, sf_dir, by=("lang", "source"), weights=None):
    w = weights if weights is not None else lexicon_model(spark)
    return score_terms(document_groups(spark, sf_dir, by), w, key_cols=["group_id", "pos"])


def _g_scored(groups_sql=O.GROUPS_LS, w=W):
    return O.scored(groups_sql, ["group_id", "pos"], [], w)


P = O.sigmoid("logit")


# ---------------------------------------------------------------- scoring
@register("sc1_score_with", f"SELECT doc_id, label, round(logit, 6) AS logit FROM {O.scored(O.PRIMARY, ['doc_id'], ['label'], W0)}")
def sc1_score_with(spark, sf_dir):
    """Arbitrary Python scorer over Arrow batches of 12 texts (mapInPandas)."""
    scored = score_with(primary_table(spark, sf_dir), lexicon_scorer(), batch_size=12)
    return scored.select("doc_id", "label", round6("logit").alias("logit"))


@register("sc2_score_terms", f"SELECT doc_id, label, candidate_id, round(logit, 6) AS logit FROM {O.scored(O.PRIMARY, ['doc_id'], ['label'], W0)}")
def sc2_score_terms(spark, sf_dir):
    """Term-weight linear scorer (one model) over whole texts."""
    s = _scored_primary(spark, sf_dir, lexicon_model(spark, (1.0,)))
    return s.select("doc_id", "label", "candidate_id", round6("logit").alias("logit"))


@register("sc3_score_candidates", f"SELECT doc_id, candidate_id, round(logit, 6) AS logit FROM {P_SCORED}")
def sc3_score_candidates(spark, sf_dir):
    """Many models in one pass over the texts."""
    return _scored_primary(spark, sf_dir).select("doc_id", "candidate_id", round6("logit").alias("logit"))


@register(
    "sc4_positive_logit",
    f"""SELECT doc_id, list(round(logit, 6) ORDER BY candidate_id) AS class_logits,
    round(list(logit ORDER BY candidate_id)[2], 6) AS positive_logit FROM {P_SCORED} GROUP BY doc_id""",
)
def sc4_positive_logit(spark, sf_dir):
    """Per-class logit arrays (one output per class) -> positive-class logit."""
    cl = class_logits(_scored_primary(spark, sf_dir), ["doc_id"])
    return cl.select(
        "doc_id",
        F.transform("class_logits", lambda x: F.round(x, 6)).alias("class_logits"),
        round6(positive_logit("class_logits")).alias("positive_logit"),
    )


@register("sc5_sigmoid", f"SELECT doc_id, candidate_id, round({P}, 6) AS prob FROM {P_SCORED}")
def sc5_sigmoid(spark, sf_dir):
    return _scored_primary(spark, sf_dir).select("doc_id", "candidate_id", round6(sigmoid(F.col("logit"))).alias("prob"))


@register("sc6_log_loss", f"SELECT doc_id, candidate_id, round({O.log_loss('label', P)}, 6) AS loss FROM {P_SCORED}")
def sc6_log_loss(spark, sf_dir):
    s = _scored_primary(spark, sf_dir)
    return s.select("doc_id", "candidate_id", round6(log_loss("label", sigmoid(F.col("logit")))).alias("loss"))


def _sc7_sql():
    toks = f"list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"
    return f"""WITH t AS (SELECT doc_id, least(len({toks}), {MAX_TOKENS}) AS n,
      row_number() OVER (ORDER BY {O.order_key('doc_id')}, doc_id) - 1 AS idx FROM documents),
    b AS (SELECT doc_id, n, idx // 12 AS batch_id FROM t)
    SELECT batch_id, count(*) AS n_rows, CAST(max(n) AS INTEGER) AS max_tokens, CAST(sum(n) AS BIGINT) AS real_tokens,
      CAST(count(*) * max(n) - sum(n) AS BIGINT) AS pad_tokens FROM b GROUP BY batch_id"""


@register("sc7_pad_batches", _sc7_sql)
def sc7_pad_batches(spark, sf_dir):
    """Truncate to 512 tokens, batch 12 rows in seeded order, pad to the batch
    maximum; report padding per batch."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    padded = pad_batches(docs, "doc_id", max_len=MAX_TOKENS, size=12)
    tail = F.slice("tokens", F.col("n_tokens") + 1, F.size("tokens"))
    is_pad = F.size(F.filter(tail, lambda t: t == F.lit("<pad>")))
    rep = padded.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("tokens")).alias("max_tokens"),
        F.sum(F.size("tokens") - is_pad).alias("real_tokens"),
        F.sum(is_pad).alias("pad_tokens"),
    )
    return rep.select(
        "batch_id",
        "n_rows",
        F.col("max_tokens").cast("int").alias("max_tokens"),
        F.col("real_tokens").cast("bigint").alias("real_tokens"),
        F.col("pad_tokens").cast("bigint").alias("pad_tokens"),
    )


# ---------------------------------------------------------------- measures
@register(
    "agg1_cross_entropy",
    f"SELECT candidate_id, count(*) AS n_rows, round(avg({O.log_loss('label', P)}), 6) AS loss FROM {P_SCORED} GROUP BY candidate_id",
)
def agg1_cross_entropy(spark, sf_dir):
    """Mean clipped log loss from logits, per model."""
    ce = cross_entropy(_scored_primary(spark, sf_dir))
    return ce.select("candidate_id", "n_rows", round6("loss").alias("loss"))


@register(
    "agg2_vprob",
    f"""SELECT candidate_id, group_id, count(*) AS n_members, round(var_samp({P}), 6) AS vprob
    FROM {_g_scored()} GROUP BY candidate_id, group_id""",
)
def agg2_vprob(spark, sf_dir):
    """Sample variance of member probabilities per (model, group)."""
    return vprob(_members(spark, sf_dir)).select("candidate_id", "group_id", "n_members", round6("vprob").alias("vprob"))


@register(
    "agg3_perf_eval",
    f"""SELECT candidate_id, count(*) AS n_rows, round(avg({O.log_loss('label', 'prob')}), 6) AS performance
    FROM (SELECT *, {P} AS prob FROM {P_SCORED}) GROUP BY candidate_id""",
)
def agg3_perf_eval(spark, sf_dir):
    """Performance from given probabilities (no sigmoid inside)."""
    probs = _scored_primary(spark, sf_dir).withColumn("prob", sigmoid(F.col("logit")))
    return perf_eval(probs).select("candidate_id", "n_rows", round6("performance").alias("performance"))


AGG4_SQL = f"""WITH v AS (SELECT candidate_id, group_id, var_samp({P}) AS vprob FROM {_g_scored(O.GROUPS_SRC)} GROUP BY ALL)
    SELECT candidate_id, count(vprob) AS n, CAST(sum(CASE WHEN vprob IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
      round(avg(vprob), 6) AS mean, round(stddev_samp(vprob), 6) AS sd FROM v GROUP BY candidate_id"""


def _round_summary(df):
    return df.select("candidate_id", "n", "n_dropped", round6("mean").alias("mean"), round6("sd").alias("sd"))


@register("agg4_summarise", AGG4_SQL)
def agg4_summarise(spark, sf_dir):
    """n, mean, sd of per-group VPROB over groups by source."""
    return _round_summary(summarise(vprob(_members(spark, sf_dir, ("source",))), "vprob"))


@register("agg5_batched_summary", AGG4_SQL)
def agg5_batched_summary(spark, sf_dir):
    """The same summary merged from batches of 8 groups (must be equal)."""
    v = vprob(_members(spark, sf_dir, ("source",)))
    idx = dense_index(v.withColumn("_ok", order_key("group_id")), ["candidate_id", "_ok", "group_id"], "_i")
    batched = idx.withColumn("batch_id", F.floor(F.col("_i") / F.lit(SAFETY_BATCH_SIZE)))
    return _round_summary(summarise_batched(batched, "vprob", "batch_id"))


# ---------------------------------------------------------------- constraints
def _measures_sql(groups_sql=O.GROUPS_LS):
    return f"""SELECT candidate_id, group_id, count(*) AS n_members, var_samp({P}) AS vprob,
      CASE WHEN count(*) >= 2 THEN max({P}) - min({P}) END AS vrange FROM {_g_scored(groups_sql)} GROUP BY ALL"""


def _bound_sql(c: Constraint, mean="mean", sd="sd", n="n"):
    return f"({c.sign!r} * {mean} + {sd} / sqrt({n}) * {O.t_q(f'{n} - 1', 1 - c.delta)} - {c.sign * c.threshold!r})"


def _cn_summary_sql(where="true"):
    return f"""WITH m AS ({_measures_sql()}),
    l AS (SELECT candidate_id, group_id, 'VPROB' AS measure, vprob AS value FROM m WHERE {where}
          UNION ALL SELECT candidate_id, group_id, 'VRANGE', vrange FROM m WHERE {where}),
    s AS (SELECT candidate_id, measure, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM l GROUP BY ALL)"""


def _cn_rows_sql(constraints, select):
    parts = []
    for c in constraints:
        parts.append(
            f"SELECT candidate_id, {O.q(c.name)} AS constraint_name, n, mean, sd, "
            f"{c.sign!r} * mean - {c.sign * c.threshold!r} AS g, {_bound_sql(c)} AS ub FROM s WHERE measure = {O.q(c.measure)}"
        )
    return f"SELECT {select} FROM (" + " UNION ALL ".join(parts) + ")"


def _spark_cn_bounds(spark, sf_dir, constraints, part=None):
    members = _members(spark, sf_dir)
    long = group_measures(members, [c.measure for c in constraints])
    if part is not None:
        long = long.filter(safety_part(F.col("group_id")) == part)
    summary = summarise(long, "value", by=("candidate_id", "measure"))
    return constraint_bounds(summary, constraints)


@register(
    "cn1_constraint_g",
    lambda: _cn_summary_sql() + " " + _cn_rows_sql(CONSTRAINTS, "candidate_id, constraint_name, n, round(mean, 6) AS measure_value, round(g, 6) AS g"),
)
def cn1_constraint_g(spark, sf_dir):
    """Constraints as data: g = measure - threshold (sign flipped for >=)."""
    b = _spark_cn_bounds(spark, sf_dir, CONSTRAINTS)
    return b.select("candidate_id", "constraint_name", "n", round6("mean").alias("measure_value"), round6("g").alias("g"))


@register(
    "cn2_user_measure",
    f"""SELECT candidate_id, group_id, n_members, 'VRANGE' AS measure, round(vrange, 6) AS value FROM ({_measures_sql()})""",
)
def cn2_user_measure(spark, sf_dir):
    """A user-registered group measure (VRANGE = max - min of p) in one aggregation."""
    long = group_measures(_members(spark, sf_dir), ["VRANGE"])
    return long.select("candidate_id", "group_id", "n_members", "measure", round6("value").alias("value"))


@register(
    "cn2_python_measure",
    lambda: f"""SELECT candidate_id, group_id, count(*) AS n_members, 'VENTROPIC' AS measure,
    round(CASE WHEN count(*) >= 2 THEN ln(avg(exp({ENTROPIC_T!r} * {O.sigmoid('logit')}))) / {ENTROPIC_T!r} - avg({O.sigmoid('logit')}) END, 6) AS value
    FROM {_g_scored(O.GROUPS_LS)} GROUP BY candidate_id, group_id""",
)
def cn2_python_measure(spark, sf_dir):
    """A user's measure in Python (init / update / merge / finish): states of each group made by all tasks, merged per group."""
    long = group_measures(_members(spark, sf_dir), ["VENTROPIC"])
    return long.select("candidate_id", "group_id", "n_members", "measure", round6("value").alias("value"))


def _cn3_sql():
    conv = f"({_measures_sql(O.GROUPS_CONV)})"
    row = "SELECT candidate_id, {q} AS quantity, {d} AS dataset, count({m}) AS n_units, CAST(ceil(count(*) / {b}) AS BIGINT) AS n_batches, round(avg({m}), 6) AS value FROM {t} GROUP BY candidate_id"
    return f"""SELECT candidate_id, 'objective' AS quantity, 'primary' AS dataset, count(*) AS n_units,
      CAST(ceil(count(*) / {PRIMARY_BATCH_SIZE}.0) AS BIGINT) AS n_batches,
      round(avg({O.log_loss('label', P)}), 6) AS value FROM {P_SCORED} GROUP BY candidate_id
    UNION ALL {row.format(q=O.q(VPROB.name), d="'conversations'", m='vprob', b=f'{SAFETY_BATCH_SIZE}.0', t=conv)}
    UNION ALL {row.format(q=O.q(VRANGE.name), d="'conversations'", m='vrange', b='5.0', t=conv)}"""


@register("cn3_bind", _cn3_sql)
def cn3_bind(spark, sf_dir):
    """Objective on the labelled documents, and two constraints bound to a
    table of their own, the conversations, each with its batch size."""
    w = lexicon_model(spark)
    talks = score_terms(conversation_groups(spark, sf_dir), w)
    bound = evaluate_bindings([bind(VPROB, "conversations", talks, SAFETY_BATCH_SIZE), bind(VRANGE, "conversations", talks, 5)])
    objective = cross_entropy(_scored_primary(spark, sf_dir, w)).select(
        "candidate_id",
        F.lit("objective").alias("quantity"),
        F.lit("primary").alias("dataset"),
        F.col("n_rows").alias("n_units"),
        F.ceil(F.col("n_rows") / F.lit(PRIMARY_BATCH_SIZE)).alias("n_batches"),
        F.col("loss").alias("value"),
    )
    return objective.unionByName(bound).withColumn("value", round6("value"))


@register(
    "cn4_t_upper_bound",
    lambda: _cn_summary_sql() + " " + _cn_rows_sql(
        [VPROB], "candidate_id, constraint_name, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(ub, 6) AS upper_bound"
    ),
)
def cn4_t_upper_bound(spark, sf_dir):
    """Student-t upper bound of g over all groups."""
    b = _spark_cn_bounds(spark, sf_dir, [VPROB])
    return b.select("candidate_id", "constraint_name", "n", round6("mean").alias("mean"), round6("sd").alias("sd"),
                    round6("upper_bound").alias("upper_bound"))


@register(
    "cn5_safety_test",
    lambda: _cn_summary_sql(f"{O.safety_part('group_id')} = 'safety'") + " " + _cn_rows_sql(
        [VPROB], "candidate_id, n AS n_units, round(ub, 6) AS upper_bound, coalesce(ub <= 0, false) AND n >= 2 AS passed"
    ),
)
def cn5_safety_test(spark, sf_dir):
    """Safety test on the held-out (safety) groups."""
    b = _spark_cn_bounds(spark, sf_dir, [VPROB], part="safety")
    # one constraint: the verdict is a column of its bound row (no second pass)
    return b.select(
        "candidate_id",
        F.col("n").alias("n_units"),
        round6("upper_bound").alias("upper_bound"),
        passes(F.col("upper_bound"), F.col("n")).alias("passed"),
    )


CN6_LIST = [VPROB, VRANGE]


@register(
    "cn5_no_evidence",
    f"""WITH m AS ({_measures_sql()}), one AS (SELECT * FROM m WHERE n_members = 1),
    s AS (SELECT candidate_id, count(vprob) AS n FROM one GROUP BY candidate_id),
    c AS (SELECT DISTINCT candidate_id FROM ({W}))
    SELECT c.candidate_id, coalesce(n, 0) AS n_units, false AS passed FROM c LEFT JOIN s ON c.candidate_id = s.candidate_id""",
)
def cn5_no_evidence(spark, sf_dir):
    """The safety test on groups of one member, where the measure is undefined
    (or on no group at all): every model has a verdict, and it is a fail."""
    w = lexicon_model(spark)
    long = group_measures(_members(spark, sf_dir), ["VPROB"]).filter("n_members = 1")
    summary = summarise(long, "value", by=("candidate_id", "measure"))
    b = constraint_bounds(summary, [VPROB], candidates=w.select("candidate_id"))
    return b.select("candidate_id", F.col("n").alias("n_units"), passes(F.col("upper_bound"), F.col("n")).alias("passed"))


@register(
    "cn6_constraint_list",
    lambda: _cn_summary_sql(f"{O.safety_part('group_id')} = 'safety'") + ", r AS (" + _cn_rows_sql(CN6_LIST, "*") + ")"
    " SELECT candidate_id, count(*) AS n_constraints, bool_and(coalesce(ub <= 0, false) AND n >= 2) AS passed FROM r GROUP BY candidate_id",
)
def cn6_constraint_list(spark, sf_dir):
    """Several constraints, each with its own delta; pass iff all pass."""
    return safety_test(_spark_cn_bounds(spark, sf_dir, CN6_LIST, part="safety"))


def _cn7_sql():
    part = O.safety_part("group_id")
    return f"""WITH m AS ({_measures_sql()}),
    c AS (SELECT candidate_id, count(vprob) AS n, avg(vprob) AS mean, stddev_samp(vprob) AS sd FROM m WHERE {part} = 'candidate' GROUP BY 1),
    s AS (SELECT candidate_id, count(vprob) AS n_safety FROM m WHERE {part} = 'safety' GROUP BY 1)
    SELECT c.candidate_id, n AS n_candidate, n_safety,
      round(mean + 2.0 * sd / sqrt(n_safety) * {O.t_q('n_safety - 1', 1 - VPROB.delta)} - {VPROB.threshold!r}, 6) AS predicted_bound
    FROM c JOIN s ON c.candidate_id = s.candidate_id"""


@register("cn7_predicted_bound", _cn7_sql)
def cn7_predicted_bound(spark, sf_dir):
    """Candidate-side prediction of the safety bound (doubled width, safety n)."""
    w = lexicon_model(spark)
    labels, small = labels_table(spark, sf_dir)
    docs = load_table(spark, sf_dir, "documents")
    st = corpus_split_stats(docs, labels, {"lang_source": GROUPINGS["lang_source"]}, w, labels_broadcast=small)
    return st.select(
        "candidate_id", F.col("n").alias("n_candidate"), "n_safety",
        round6(predicted_bound(F.col("mean"), F.col("sd"), F.col("n_safety"), VPROB)).alias("predicted_bound"),
    )


def _cn8_sql():
    parts = []
    for name, gsql in GROUPINGS_SQL.items():
        parts.append(
            f"""SELECT {O.q(name)} AS grouping, candidate_id, [round(avg(vprob) - {VPROB.threshold!r}, 6)] AS gvec
            FROM ({_measures_sql(gsql)}) GROUP BY candidate_id"""
        )
    return " UNION ALL ".join(parts)


@register("cn8_true_g", _cn8_sql)
def cn8_true_g(spark, sf_dir):
    """Ground-truth g (point estimate on the whole group table) per model, for
    two groupings from one scan: members are scored once and emit one row per
    grouping."""
    from ..sources.standins import group_id_of

    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", *[group_id_of(*by).alias(f"_g_{n}") for n, by in GROUPINGS.items()])
    scored = score_terms(docs, lexicon_model(spark), key_cols=["doc_id"])
    keyed = scored.select(
        "candidate_id",
        "logit",
        F.explode_outer(F.array(*[F.struct(F.lit(n).alias("grouping"), F.col(f"_g_{n}").alias("group_id")) for n in GROUPINGS])).alias("_k"),
    ).select("_k.grouping", "_k.group_id", "candidate_id", "logit")
    s = summarise(vprob(keyed, by=("grouping", "candidate_id")), "vprob", by=("grouping", "candidate_id"))
    return s.select("grouping", "candidate_id", F.array(round6(g_value(F.col("mean"), VPROB))).alias("gvec"))


# ---------------------------------------------------------------- selection, gradients
def _trn1_sql():
    parts = []
    for name, gsql in GROUPINGS_SQL.items():
        gp = O.safety_part("group_id")
        parts.append(f"""(WITH ps AS {P_SCORED},
        loss AS (SELECT candidate_id, avg({O.log_loss('label', P)}) AS loss FROM ps
                 WHERE {O.safety_part('doc_id')} = 'candidate' GROUP BY candidate_id),
        m AS ({_measures_sql(gsql)}),
        c AS (SELECT candidate_id, count(vprob) AS n, avg(vprob) AS mean, stddev_samp(vprob) AS sd FROM m WHERE {gp} = 'candidate' GROUP BY 1),
        s AS (SELECT candidate_id, count(vprob) AS ns FROM m WHERE {gp} = 'safety' GROUP BY 1),
        st AS (SELECT c.candidate_id, loss.loss, c.n,
                 mean + 2.0 * sd / sqrt(ns) * {O.t_q('ns - 1', 1 - VPROB.delta)} - {VPROB.threshold!r} AS pb
               FROM c JOIN s ON c.candidate_id = s.candidate_id JOIN loss ON loss.candidate_id = c.candidate_id),
        b AS (SELECT * FROM st WHERE coalesce(pb <= 0, false) AND n >= 2 AND loss IS NOT NULL
              ORDER BY loss, candidate_id LIMIT 1)
        SELECT {O.q(name)} AS grouping, b.candidate_id IS NOT NULL AS solution_found, b.candidate_id,
               round(b.loss, 6) AS loss, round(b.pb, 6) AS predicted_bound
        FROM (SELECT 1 AS one) d LEFT JOIN b ON true)""")
    return " UNION ALL ".join(parts)


@register("trn1_select_candidate", _trn1_sql)
def trn1_select_candidate(spark, sf_dir):
    """Candidate selection: lowest loss whose predicted safety bound is <= 0,
    for two groupings at once (one scan of the corpus)."""
    w = lexicon_model(spark)
    labels, small = labels_table(spark, sf_dir)
    docs = load_table(spark, sf_dir, "documents")
    st = corpus_split_stats(docs, labels, GROUPINGS, w, labels_broadcast=small)
    st = st.withColumn("predicted_bound", predicted_bound(F.col("mean"), F.col("sd"), F.col("n_safety"), VPROB))
    sel = select_candidate(st, by=("grouping",))
    return sel.select(
        "grouping", "solution_found", "candidate_id", round6("loss").alias("loss"), round6("predicted_bound").alias("predicted_bound")
    )


LEX_SQL = ", ".join(O.q(t) for t in LEXICON)


def _trn2_sql(scored=P_SCORED):
    r = f"(-CAST(label AS DOUBLE) / (p + {O.C}) + (1.0 - label) / (1.0 - p + {O.C})) * p * (1.0 - p)"
    return f"""WITH s AS (SELECT *, {P} AS p FROM {scored}),
    r AS (SELECT doc_id, candidate_id, {r} AS r FROM s),
    h AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({O.tokens_sql('text')}) AS term FROM ({O.PRIMARY}))
          WHERE term IN ({LEX_SQL})),
    x AS (SELECT candidate_id, CAST(NULL AS VARCHAR) AS term, r FROM r
          UNION ALL SELECT r.candidate_id, h.term, r.r FROM r JOIN h ON r.doc_id = h.doc_id),
    n AS (SELECT candidate_id, count(*) AS n FROM r GROUP BY 1)
    SELECT x.candidate_id, term, round(sum(r) / any_value(n.n), 6) AS grad FROM x JOIN n ON x.candidate_id = n.candidate_id
    GROUP BY x.candidate_id, term"""


@register("trn2_loss_gradient", _trn2_sql)
def trn2_loss_gradient(spark, sf_dir):
    """Gradient of the mean log loss w.r.t. every weight (term NULL = bias)."""
    g = loss_gradient_from_hits(labelled_hits(spark, sf_dir, lexicon_model(spark)))
    return g.select("candidate_id", "term", round6("grad").alias("grad"))


def _trn3_sql(w=W):
    return f"""WITH s AS (SELECT *, {P} AS p FROM {_g_scored(w=w)}),
    g AS (SELECT candidate_id, group_id, count(*) AS n, avg(p) AS pbar FROM s GROUP BY 1, 2 HAVING count(*) >= 2),
    c AS (SELECT s.candidate_id, s.group_id, s.pos, 2.0 / (g.n - 1) * (s.p - g.pbar) * s.p * (1.0 - s.p) AS k
          FROM s JOIN g ON s.candidate_id = g.candidate_id AND s.group_id = g.group_id),
    h AS (SELECT group_id, pos, term FROM (SELECT group_id, pos, unnest({O.tokens_sql('text')}) AS term FROM ({O.GROUPS_LS}))
          WHERE term IN ({LEX_SQL})),
    x AS (SELECT candidate_id, CAST(NULL AS VARCHAR) AS term, k FROM c
          UNION ALL SELECT c.candidate_id, h.term, c.k FROM c JOIN h ON c.group_id = h.group_id AND c.pos = h.pos),
    ng AS (SELECT candidate_id, count(*) AS ng FROM g GROUP BY 1)
    SELECT x.candidate_id, term, round(sum(k) / any_value(ng.ng), 6) AS grad
    FROM x JOIN ng ON x.candidate_id = ng.candidate_id GROUP BY x.candidate_id, term"""


@register("trn3_variance_gradient", _trn3_sql)
def trn3_variance_gradient(spark, sf_dir):
    """Gradient of the mean within-group variance of p w.r.t. every weight."""
    g = variance_gradient(document_groups(spark, sf_dir), lexicon_model(spark))
    return g.select("candidate_id", "term", round6("grad").alias("grad"))


# Models beyond the inline scorer's bound: 30 candidates of eleven parameters.
MANY_WEIGHTS = tuple(round(0.1 * (i + 1), 1) for i in range(30))
MANY = O.weights_values(MANY_WEIGHTS)
MANY_SCORED = O.scored(O.PRIMARY, ["doc_id"], ["label"], MANY)


@register("sc3_join_scorer", f"SELECT doc_id, candidate_id, round(logit, 6) AS logit FROM {MANY_SCORED}")
def sc3_join_scorer(spark, sf_dir):
    """Models too large to inline, scored by joining counted tokens with the parameters."""
    s = score_terms(primary_table(spark, sf_dir), lexicon_model(spark, MANY_WEIGHTS))
    return s.select("doc_id", "candidate_id", round6("logit").alias("logit"))


@register("trn2_large_model", lambda: _trn2_sql(MANY_SCORED))
def trn2_large_model(spark, sf_dir):
    """Loss gradient of models too large to inline."""
    g = loss_gradient_from_hits(labelled_hits(spark, sf_dir, lexicon_model(spark, MANY_WEIGHTS)))
    return g.select("candidate_id", "term", round6("grad").alias("grad"))


@register("trn3_large_model", lambda: _trn3_sql(MANY))
def trn3_large_model(spark, sf_dir):
    """Variance gradient of models too large to inline."""
    g = variance_gradient(document_groups(spark, sf_dir), lexicon_model(spark, MANY_WEIGHTS))
    return g.select("candidate_id", "term", round6("grad").alias("grad"))
