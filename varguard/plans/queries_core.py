"""Registered queries: slice 1 (flagship) and the scoring / measure operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import VPROB, Constraint
from ..operators.score import lexicon_model
from ..session import load_table
from ..sources.standins import labels_table
from . import oracle as O
from .catalog import register
from .safety import corpus_safety_report

W = O.weights_values()


def _flagship_sql() -> str:
    s = O.scored(O.PRIMARY, ["doc_id"], ["label"], W)
    m = O.scored(O.GROUPS_LS, ["group_id", "pos"], [], W)
    p = O.sigmoid("logit")
    return f"""
    WITH s AS {s},
    loss AS (SELECT candidate_id, count(*) AS n_rows, avg({O.log_loss('label', p)}) AS loss
             FROM s GROUP BY candidate_id),
    m AS {m},
    v AS (SELECT candidate_id, group_id, var_samp({p}) AS vprob FROM m GROUP BY candidate_id, group_id),
    su AS (SELECT candidate_id, count(vprob) AS n,
                  CAST(sum(CASE WHEN vprob IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
                  avg(vprob) AS mean, stddev_samp(vprob) AS sd FROM v GROUP BY candidate_id),
    b AS (SELECT *, mean + sd / sqrt(n) * {O.t_q('n - 1', 1 - VPROB.delta)} - {VPROB.threshold!r} AS ub FROM su)
    SELECT l.candidate_id, n_rows, round(loss, 6) AS loss, n AS n_groups, n_dropped,
           round(mean, 6) AS mean_vprob, round(sd, 6) AS sd_vprob, round(ub, 6) AS upper_bound,
           coalesce(ub <= 0, false) AND n >= 2 AS passed
    FROM loss l JOIN b ON l.candidate_id = b.candidate_id
    """


@register("flagship_safety_report", _flagship_sql)
def flagship_safety_report(spark, sf_dir):
    """Loss and VPROB safety verdict per scorer on documents x labels and
    document groups by (lang, source)."""
    labels, small = labels_table(spark, sf_dir)
    docs = load_table(spark, sf_dir, "documents")
    return corpus_safety_report(docs, labels, ("lang", "source"), lexicon_model(spark), labels_broadcast=small)


RANGE_LIMIT = Constraint("VRANGE <= 0.10", "VRANGE", "<=", 0.10, 0.10)


def _two_measures_sql() -> str:
    s = O.scored(O.PRIMARY, ["doc_id"], ["label"], W)
    m = O.scored(O.GROUPS_LS, ["group_id", "pos"], [], W)
    p = O.sigmoid("logit")
    bound = lambda c, v: f"avg({v}) + stddev_samp({v}) / sqrt(count({v})) * {O.t_q(f'count({v}) - 1', 1 - c.delta)} - {c.threshold!r}"
    return f"""
    WITH s AS {s}, m AS {m},
    loss AS (SELECT candidate_id, count(*) AS n_rows, avg({O.log_loss('label', p)}) AS loss FROM s GROUP BY candidate_id),
    v AS (SELECT candidate_id, var_samp({p}) AS a, CASE WHEN count(*) >= 2 THEN max({p}) - min({p}) END AS b
          FROM m GROUP BY candidate_id, group_id),
    r AS (SELECT candidate_id, count(a) AS n, count(*) - count(a) AS d, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb,
                 stddev_samp(b) AS sb, {bound(VPROB, 'a')} AS ua, {bound(RANGE_LIMIT, 'b')} AS ub FROM v GROUP BY candidate_id)
    SELECT candidate_id, n_rows, round(loss, 6) AS loss, n AS n_groups, d AS n_dropped, round(ma, 6) AS mean_vprob, round(sa, 6) AS sd_vprob,
           round(mb, 6) AS mean_vrange, round(sb, 6) AS sd_vrange, round(greatest(ua, ub), 6) AS upper_bound,
           coalesce(ua <= 0 AND ub <= 0, false) AND n >= 2 AS passed
    FROM loss JOIN r USING (candidate_id)
    """


@register("cn6_report_two_measures", _two_measures_sql)
def cn6_report_two_measures(spark, sf_dir):
    """The flagship report under two constraints with measures and confidences of their own."""
    labels, small = labels_table(spark, sf_dir)
    docs = load_table(spark, sf_dir, "documents")
    return corpus_safety_report(docs, labels, ("lang", "source"), lexicon_model(spark), [VPROB, RANGE_LIMIT], labels_broadcast=small)
