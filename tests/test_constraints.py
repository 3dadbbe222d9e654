import pytest
from pyspark.sql import functions as F

from varguard.config import Constraint, VPROB
from varguard.functions.stats import t_ppf
from varguard.operators.constraints import (
    constraint_bounds,
    group_measures,
    passes,
    register_measure,
    safety_test,
    t_upper_bound,
)
from varguard.operators.measures import summarise
from varguard.operators.train import select_candidate
from varguard.sources.standins import group_id_of


def test_upper_bound_formula(spark):
    df = spark.createDataFrame([(10, 0.02, 0.01)], "n long, mean double, sd double")
    got = df.select(t_upper_bound(F.col("n"), F.col("mean"), F.col("sd"), VPROB).alias("b")).first().b
    want = 0.02 + 0.01 / 10**0.5 * t_ppf(0.95, 9) - 0.05
    assert got == pytest.approx(want, rel=1e-12)


def test_ge_constraint_flips_sign(spark):
    c = Constraint("VPROB >= 0.001", "VPROB", ">=", 0.001, 0.05)
    df = spark.createDataFrame([(0, "VPROB", 10, 0, 0.02, 0.01)], "candidate_id int, measure string, n long, n_dropped long, mean double, sd double")
    row = constraint_bounds(df, [c]).first()
    assert row.g == pytest.approx(0.001 - 0.02)
    assert row.upper_bound == pytest.approx(-0.02 + 0.01 / 10**0.5 * t_ppf(0.95, 9) + 0.001, rel=1e-12)


def test_empty_group_table_fails_safety(spark):
    empty = spark.createDataFrame([], "candidate_id int, group_id long, pos long, logit double")
    summary = summarise(group_measures(empty, ["VPROB"]), "value", by=("candidate_id", "measure"))
    # no rows at all: a model with no evidence cannot pass
    cand = spark.createDataFrame([(0,)], "candidate_id int")
    verdict = safety_test(constraint_bounds(summary, [VPROB], candidates=cand)).collect()
    assert [(r.candidate_id, r.n_constraints, r.passed) for r in verdict] == [(0, 1, False)]


def test_absent_measure_fails_the_list(spark):
    other = Constraint("VRANGE <= 0.1", "VRANGE", "<=", 0.1, 0.05)
    df = spark.createDataFrame([(0, "VPROB", 10, 0, 0.001, 0.001)], "candidate_id int, measure string, n long, n_dropped long, mean double, sd double")
    row = safety_test(constraint_bounds(df, [VPROB, other])).first()
    assert row.n_constraints == 2 and row.passed is False
    assert safety_test(constraint_bounds(df, [VPROB])).first().passed is True


def test_report_uses_the_constraints_own_measure(spark):
    from varguard.operators.score import lexicon_model
    from varguard.plans.safety import corpus_safety_report, safety_report

    docs = spark.createDataFrame(
        [(i, "idiot scum" if i % 3 == 0 else "fine words", "en" if i < 12 else None, "a:b" if i % 2 else "a") for i in range(24)],
        "doc_id long, text string, lang string, source string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(0, 1), (0, 1)], "doc_id long, label int")
    w = lexicon_model(spark)
    groups = docs.select(group_id_of("lang", "source").alias("group_id"), F.col("doc_id").alias("pos"), "text")
    primary = docs.join(labels, "doc_id").select("doc_id", "label", "text")
    both = [VPROB, Constraint("VRANGE <= 0.05", "VRANGE", "<=", 0.05, 0.05)]
    for c in (VPROB, both[1], both):
        a = safety_report(primary, groups, w, c).orderBy("candidate_id").collect()
        assert corpus_safety_report(docs, labels, ("lang", "source"), w, c).orderBy("candidate_id").collect() == a
        assert a[0].n_rows == 26  # a label row each, though repeated
        assert "VRANGE" not in str(c) or a[0].passed is False
    with pytest.raises(KeyError):
        safety_report(primary, groups, w, Constraint("x", "NOSUCH", "<=", 1.0, 0.05))


def test_group_keys_do_not_collide(spark):
    keys = [("a:b", "c"), ("a", "b:c"), (None, "x"), ("x", None), ("", "x"), ("-", "x"), (None, None), ("1=a", "b")]
    got = spark.createDataFrame(keys, "l string, s string").select(group_id_of("l", "s").alias("g")).collect()
    assert len({r.g for r in got}) == len(keys)


def test_checkpoint_folder_is_local_only_for_a_local_master():
    from types import SimpleNamespace

    from varguard.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_fewer_than_two_units_fails(spark):
    df = spark.createDataFrame([(1, -1.0), (2, -1.0)], "n long, b double")
    got = [r.p for r in df.select(passes(F.col("b"), F.col("n")).alias("p")).collect()]
    assert got == [False, True]


def test_no_feasible_candidate_gives_no_solution(spark):
    st = spark.createDataFrame([(0, 0.2, 0.01, 5), (1, 0.1, 0.02, 5)], "candidate_id int, loss double, predicted_bound double, n long")
    row = select_candidate(st).first()
    assert row.solution_found is False and row.candidate_id is None


def test_lowest_feasible_loss_is_selected(spark):
    st = spark.createDataFrame([(0, 0.2, -0.01, 5), (1, 0.1, 0.02, 5), (2, 0.15, -0.02, 5), (3, 0.15, -0.03, 5)],
                               "candidate_id int, loss double, predicted_bound double, n long")
    row = select_candidate(st).first()
    assert row.solution_found and row.candidate_id == 2


def test_user_measure_registration(spark):
    register_measure("VMAX", lambda p: F.max(p))
    m = spark.createDataFrame([(0, 1, 0, 0.0), (0, 1, 1, 100.0)], "candidate_id int, group_id long, pos long, logit double")
    row = group_measures(m, ["VMAX", "VPROB"]).orderBy("measure").collect()
    assert [r.measure for r in row] == ["VMAX", "VPROB"]
    assert row[0].value == pytest.approx(1.0)


def test_constraints_bound_to_their_own_tables(spark):
    from varguard.operators.constraints import bind, evaluate_bindings

    small = spark.createDataFrame([(0, 1, 0.0), (0, 1, 1.0), (0, 2, 0.5)], "candidate_id int, group_id long, logit double")
    large = spark.createDataFrame([(0, g, float(i)) for g in range(7) for i in range(2)], "candidate_id int, group_id long, logit double")
    spread = Constraint("VRANGE <= 0.5", "VRANGE", "<=", 0.5, 0.05)
    limit = Constraint("VPROB <= 0.05", "VPROB", "<=", 0.05, 0.05)
    got = {(r.quantity, r.dataset): r for r in evaluate_bindings([bind(limit, "a", small, 2), bind(spread, "b", large, 3), bind(limit, "b", large, 7)]).collect()}
    gap = 1 / (1 + 2.718281828459045**-1.0) - 0.5
    assert got["VPROB <= 0.05", "a"].n_units == 1 and got["VPROB <= 0.05", "a"].n_batches == 1  # one group has no variance
    assert got["VRANGE <= 0.5", "b"].n_units == 7 and got["VRANGE <= 0.5", "b"].n_batches == 3
    assert abs(got["VRANGE <= 0.5", "b"].value - gap) < 1e-9 and abs(got["VPROB <= 0.05", "b"].value - gap * gap / 2) < 1e-9


def test_unknown_measure_cannot_be_bound(spark):
    import pytest

    from varguard.operators.constraints import bind

    with pytest.raises(KeyError):
        bind(Constraint("x", "NOPE", "<=", 0.5, 0.05), "a", spark.range(1), 2)
