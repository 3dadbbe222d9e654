"""Constraint lists, user's measures and metrics, resumed grids."""

import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from varguard.config import VPROB, Constraint, ExperimentConfig
from varguard.functions.scalar import sigmoid
from varguard.operators.constraints import (
    _MERGEABLE,
    Mergeable,
    constraint_bounds,
    group_measures,
    merged_measure,
    partial_states,
    register_measure,
    register_mergeable,
    safety_test,
)
from varguard.operators.measures import metric, register_metric, summarise
from varguard.operators.score import lexicon_model
from varguard.plans.experiment import (
    corpus_moments,
    corpus_unit_values,
    experiment_moments,
    failure_rate,
    pending_cells,
    results_from_moments,
    resume_experiment,
    row_terms,
    run_corpus_experiment,
    run_experiment,
)
from varguard.session import load_table
from varguard.sources.results import read_trials, write_trials
from varguard.sources.standins import document_groups, labels_table, primary_table

TWO = ExperimentConfig(n_trials=3, constraints=(VPROB, Constraint("VENTROPIC <= 0.1", "VENTROPIC", "<=", 0.1, 0.2)), performance="balanced_accuracy")


def members_frame(spark, n=3000):
    """A hot group with a third of all rows, small groups, a null group, null scores."""
    rows = [(1, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"g{i % 97}", None if i % 50 == 0 else (i * 37 % 101) / 20 - 2.5) for i in range(n)]
    return spark.createDataFrame(rows + [(1, "one", 0.5)], "candidate_id int, group_id string, logit double").repartition(9), rows + [(1, "one", 0.5)]


def test_a_python_measure_merges_like_the_whole_group(spark):
    members, rows = members_frame(spark)
    got = {r["group_id"]: r for r in group_measures(members, ["VPROB", "VENTROPIC"]).where("measure = 'VENTROPIC'").collect()}
    want = defaultdict(list)
    for _, g, z in rows:
        want[g].append(None if z is None else 1 / (1 + math.exp(-z)))
    assert set(got) == set(want)
    for g, p in want.items():
        known = np.array([x for x in p if x is not None])
        value = np.log(np.exp(10 * known).mean()) / 10 - known.mean() if len(known) >= 2 else None
        assert got[g]["n_members"] == len(p)
        assert (got[g]["value"] is None) == (value is None) and (value is None or abs(got[g]["value"] - value) < 1e-12)


def test_a_hot_group_is_one_state_for_each_task(spark):
    members, _ = members_frame(spark)
    keyed = members.select("candidate_id", "group_id", sigmoid("logit").alias("p"))
    m = Mergeable(lambda: (0.0,), lambda s, p: (s[0] + len(p),), lambda a, b: (a[0] + b[0],), lambda s: s[0])
    states = partial_states(keyed, ["candidate_id", "group_id"], m)
    assert states.where("group_id = 'hot'").count() == 9
    few = partial_states(keyed, ["candidate_id", "group_id"], m, held_groups=10)  # sent on early, merged all the same
    assert few.where("group_id = 'hot'").count() >= 9
    merged = {r["group_id"]: (r["n_members"], r["value"]) for r in merged_measure(keyed, ["candidate_id", "group_id"], m).collect()}
    assert merged["hot"][0] == 1000 and merged["hot"][1] == keyed.where("group_id = 'hot' AND p IS NOT NULL").count()
    assert merged_measure(keyed.limit(0), ["candidate_id", "group_id"], m).count() == 0


def test_a_name_has_one_measure():
    register_mergeable("_SWAP", lambda: (0.0,), lambda s, p: s, lambda a, b: a, lambda s: 0.0)
    assert "_SWAP" in _MERGEABLE
    register_measure("_SWAP", F.max)
    assert "_SWAP" not in _MERGEABLE
    with pytest.raises(KeyError, match="VENTROPIC"):
        from varguard.operators.constraints import check_measure

        check_measure("nothing")


def test_a_python_measure_in_a_safety_test(spark):
    members, _ = members_frame(spark)
    c = [VPROB, Constraint("strict", "VENTROPIC", "<=", -1.0, 0.05)]
    summary = summarise(group_measures(members, [x.measure for x in c]), "value", by=("candidate_id", "measure"))
    rows = {r["constraint_name"]: r for r in constraint_bounds(summary, c).collect()}
    assert rows["strict"]["upper_bound"] > 0 and rows["strict"]["n"] > 50
    assert safety_test(constraint_bounds(summary, c)).first()["passed"] is False


def test_corpus_and_plain_experiment_agree_under_a_list(spark):
    labels, small = labels_table(spark, SF_SMALL)
    w = lexicon_model(spark, (0.5, 2.0))
    a = run_corpus_experiment(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), w, TWO, small)
    b = run_experiment(primary_table(spark, SF_SMALL), document_groups(spark, SF_SMALL), w, TWO)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a) == rows(b) and all(len(r["gvec"]) == 2 for r in a.collect())
    assert run_corpus_experiment(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), w, TWO, False).count() == 30


def moments(spark, cfg, safe=(True, True), evaluated=None):
    """One candidate; each constraint's safety mean just under or over its threshold, constant values."""
    rows = []
    for trial, parts in ((-1, ["all"]), (0, ["candidate", "safety"])):
        for part in parts:
            rows.append((trial, "p", part, 0, 0, 10, 5.0, 2.5, 10))
            for i, ok in enumerate(safe):
                v = 0.01 if ok or part != "safety" else 0.9
                rows.append((trial, f"g{i or ''}", part, 0, 0, 10, 10 * v, 10 * v * v, 10))
    return spark.createDataFrame(rows, "trial_i int, kind string, part string, frac_id int, cand_idx int, sw long, swx double, swx2 double, nu long")


@pytest.mark.parametrize("safe", [(True, True), (True, False), (False, True)])
def test_every_constraint_must_be_safe(spark, safe):
    cfg = ExperimentConfig(n_trials=1, fracs=(1.0,), constraints=(VPROB, Constraint("r", "VRANGE", "<=", 0.2, 0.3)))
    row = results_from_moments(moments(spark, cfg, safe), [7], cfg).first()
    assert row["passed_safety"] == all(safe)
    assert row["gvec"] == ([-0.04, -0.19] if all(safe) else [float("-inf")] * 2) and row["performance"] == (0.5 if all(safe) else None)


def test_any_violated_constraint_is_a_failure(spark):
    rows = [(0, 1.0, True, [-0.1, 0.2]), (0, 1.0, True, [-0.1, -0.2]), (0, 1.0, False, [float("-inf")] * 2)]
    df = spark.createDataFrame(rows, "frac_id int, data_frac double, passed_safety boolean, gvec array<double>")
    assert abs(failure_rate(df).first()["failure_rate"] - 1 / 3) < 1e-12


def test_metrics_are_named_and_of_several_terms(spark):
    register_metric("_f1", lambda y, p: [y * (p >= 0.5).cast("int"), y + (p >= 0.5).cast("int")], lambda m: 2 * m[0] / m[1])
    cfg = ExperimentConfig(n_trials=1, performance="_f1")
    makers, first = row_terms(cfg)
    assert first == 1 and row_terms(ExperimentConfig())[1] == 0 and len(makers) == 2
    labels, small = labels_table(spark, SF_SMALL)
    mom, _ = corpus_moments(load_table(spark, SF_SMALL, "documents"), labels, ("source",), lexicon_model(spark, (2.0,)), cfg, small)
    true = {r["kind"]: r["swx"] / r["sw"] for r in mom.where("trial_i = -1").collect()}
    scored = [(r["label"], r["p"]) for r in _scored(spark)]
    hit, both = sum(y * (p >= 0.5) for y, p in scored), sum(y + (p >= 0.5) for y, p in scored)
    assert abs(2 * true["p1"] / true["p2"] - 2 * hit / both) < 1e-12
    with pytest.raises(KeyError):
        metric("nothing")
    with pytest.raises(ValueError):
        ExperimentConfig(evaluations=("VRANGE", "VRANGE"))


def _scored(spark):
    from varguard.operators.score import score_terms

    return score_terms(primary_table(spark, SF_SMALL), lexicon_model(spark, (2.0,))).select("label", sigmoid("logit").alias("p")).collect()


def test_folded_cells_equal_moments_of_rows(spark):
    """Label rows summed into cells where they are scored; a repeated, a null and an unknown label among them."""
    labels, small = labels_table(spark, SF_SMALL)
    first = labels.first()["doc_id"]
    labels = labels.unionByName(spark.createDataFrame([(first, 1), (first, None), (10**9, 1), (None, 1)], "doc_id long, label int"), allowMissingColumns=True)
    docs, w, cfg = load_table(spark, SF_SMALL, "documents"), lexicon_model(spark, (0.5, 2.0)), ExperimentConfig(n_trials=3)
    units, cands = corpus_unit_values(docs, labels, ("lang", "source"), w, small)
    keys = ["trial_i", "kind", "part", "frac_id", "cand_idx"]
    plain = {tuple(r[k] for k in keys): r for r in experiment_moments(units, cfg, len(cands)).collect()}
    folded = {tuple(r[k] for k in keys): r for r in corpus_moments(docs, labels, ("lang", "source"), w, cfg, small)[0].collect()}
    assert set(plain) == set(folded)
    for key, a in plain.items():
        b = folded[key]
        assert (a["sw"], a["nu"]) == (b["sw"], b["nu"]) and abs(a["swx"] - b["swx"]) < 1e-9
        assert key[1] == "p" or abs(a["swx2"] - b["swx2"]) < 1e-9


def test_the_experiment_shuffles_groups_and_cells_only(spark):
    labels, small = labels_table(spark, SF_SMALL)
    docs, w, cfg = load_table(spark, SF_SMALL, "documents"), lexicon_model(spark, (0.5, 2.0)), ExperimentConfig()
    from varguard.plans.experiment import drawn_cells

    fold = lambda i: F.transform(drawn_cells(cfg, F.lit("p"), i), lambda c: F.struct((c["trial_i"] * 30 + c["part"] * 10 + c["frac_id"]).cast("long").alias("unit"), c["w"].alias("w")))
    units, _ = corpus_unit_values(docs, labels, ("lang", "source"), w, small, fold=fold)
    assert units.where("kind = 'p'").count() <= 1 + cfg.n_trials * 2 * len(cfg.fracs)
    plan = corpus_moments(docs, labels, ("lang", "source"), w, cfg, True)[0]._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert shuffles and not any("hashpartitioning(doc_id" in x for x in shuffles)


def test_resume_draws_only_pending_trials(spark, tmp_path):
    cfg = ExperimentConfig(n_trials=4)
    labels, small = labels_table(spark, SF_SMALL)
    units, cands = corpus_unit_values(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), lexicon_model(spark, (0.5, 2.0)), small)
    units = units.checkpoint()
    whole = experiment_moments(units, cfg, len(cands))
    some = experiment_moments(units, cfg, len(cands), pending={2: 9, 3: 4})
    assert {r[0] for r in some.select("trial_i").distinct().collect()} <= {-1, 2, 3}
    assert some.where("trial_i = 3").agg(F.max("frac_id")).first()[0] <= 4
    key = "trial_i, kind, part, frac_id, cand_idx, sw, nu"
    assert not set(map(str, some.selectExpr(key.split(", ")).collect())) - set(map(str, whole.selectExpr(key.split(", ")).collect()))

    from varguard.plans.experiment import results_from_units

    full, cells = results_from_units(units, cands, cfg), str(tmp_path / "cells")
    assert pending_cells(spark, cells, cfg).count() == 40
    write_trials(full.where("trial_i < 2 OR (trial_i = 3 AND frac_id > 4)"), cells)
    assert sorted(map(tuple, pending_cells(spark, cells, cfg).collect())) == sorted([(f, 2) for f in range(10)] + [(f, 3) for f in range(5)])
    assert resume_experiment(units, cands, cells, cfg) == 15
    assert resume_experiment(units, cands, cells, cfg) == 0
    order = [*full.columns]
    assert sorted(map(str, read_trials(spark, cells).select(order).collect())) == sorted(map(str, full.collect()))


def test_only_a_missing_folder_means_nothing_is_recorded(spark, monkeypatch):
    import varguard.sources.results as results

    def broken(*_):
        return spark.sql("SELECT nothing FROM range(1)")

    monkeypatch.setattr(results, "read_trials", broken)
    with pytest.raises(AnalysisException):
        pending_cells(spark, "anywhere")
