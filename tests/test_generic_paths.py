"""The generic two-table entry points equal the single-scan corpus versions."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from varguard.config import ExperimentConfig
from varguard.operators.score import lexicon_model
from varguard.plans.experiment import corpus_split_stats, corpus_unit_values, results_from_units, run_experiment
from varguard.plans.safety import corpus_safety_report, safety_report, split_measure_stats
from varguard.session import load_table
from varguard.sources.standins import document_groups, labels_table, primary_table


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


def test_safety_report_paths_agree(spark):
    w = lexicon_model(spark)
    labels, small = labels_table(spark, SF_SMALL)
    a = safety_report(primary_table(spark, SF_SMALL), document_groups(spark, SF_SMALL), w)
    b = corpus_safety_report(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), w, labels_broadcast=small)
    assert _rows(a, a.columns) == _rows(b, a.columns)


def test_split_stats_paths_agree(spark):
    w = lexicon_model(spark)
    labels, small = labels_table(spark, SF_SMALL)
    a = split_measure_stats(primary_table(spark, SF_SMALL), document_groups(spark, SF_SMALL), w)
    b = corpus_split_stats(load_table(spark, SF_SMALL, "documents"), labels, {"ls": ("lang", "source")}, w, small)
    cols = ["candidate_id", "loss", "n", "mean", "sd", "n_safety", "mean_safety", "sd_safety"]
    assert _rows(a, cols) == _rows(b, cols)


def test_experiment_paths_agree(spark):
    cfg = ExperimentConfig(n_trials=3)
    w = lexicon_model(spark, (0.5, 2.0))
    a = run_experiment(primary_table(spark, SF_SMALL), document_groups(spark, SF_SMALL), w, cfg)
    labels, small = labels_table(spark, SF_SMALL)
    units, cands = corpus_unit_values(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), w, small)
    b = results_from_units(units, cands, cfg)
    cols = ["frac_id", "trial_i", "candidate_id", "performance", "passed_safety"]
    assert _rows(a, cols) == _rows(b, cols)
    assert sorted((r.frac_id, r.trial_i, tuple(r.gvec)) for r in a.collect()) == sorted(
        (r.frac_id, r.trial_i, tuple(r.gvec)) for r in b.collect()
    )


def test_label_rows_are_folded_before_the_shuffle(spark):
    """Folded label rows are one unit for each value, with the same sums; groups are unchanged."""
    w = lexicon_model(spark)
    labels, small = labels_table(spark, SF_SMALL)
    docs = load_table(spark, SF_SMALL, "documents")
    plain, _ = corpus_unit_values(docs, labels, ("lang", "source"), w, small)
    folded, _ = corpus_unit_values(docs, labels, ("lang", "source"), w, small, fold=F.col("doc_id") % 2)
    p = {r.unit: r for r in folded.filter("kind = 'p'").collect()}
    rows = plain.filter("kind = 'p'").collect()
    assert sorted(p) == [0, 1] and sum(r.n for r in p.values()) == len(rows)
    for parity, r in p.items():
        want = sum(x.xs[0] for x in rows if x.unit % 2 == parity)
        assert abs(r.xs[0] - want) < 1e-9
    groups = lambda u: sorted((r.unit, [None if x is None else round(x, 12) for x in r.xs]) for r in u.filter("kind = 'g'").collect())
    assert groups(plain) == groups(folded)
