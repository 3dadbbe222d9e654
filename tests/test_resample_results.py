import os

import pytest
from pyspark.sql import functions as F

from varguard.config import frac_grid_values
from varguard.operators.resample import bootstrap, bootstrap_weights, frac_ids, pending_trials, trial_grid
from varguard.sources.results import decode_gvec, encode_gvec, read_trials, write_trials


def test_poisson_weights_mean_one(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    w = bootstrap_weights(df, "k", 3)
    stats = w.groupBy("trial_i").agg(F.avg("w").alias("m"), F.variance("w").alias("v")).collect()
    for r in stats:
        assert r.m == pytest.approx(1.0, abs=0.03)
        assert r.v == pytest.approx(1.0, abs=0.05)


def test_exact_bootstrap_draw_counts(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    d = bootstrap(df, "k", trials=3)
    per_trial = {r.trial_i: r.c for r in d.groupBy("trial_i").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert per_trial == {0: 40, 1: 40, 2: 40}
    assert d.select("k").distinct().count() < 40 * 3  # with replacement: repeats occur


def test_fraction_subsets_are_nested(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("trial_i", F.lit(0))
    f = frac_ids(df, "k")
    sizes = [f.filter(F.col("min_frac_id") <= k).count() for k in range(10)]
    assert sizes == sorted(sizes) and sizes[-1] == 5000
    fr = frac_grid_values()
    assert fr[0] == pytest.approx(10**-2.5) and fr[-1] == 1.0


def test_pending_trials_anti_join(spark):
    grid = trial_grid(spark.range(1).select(), 2, [0.5, 1.0]).select("frac_id", "trial_i")
    done = spark.createDataFrame([(0, 1), (1, 0)], "frac_id int, trial_i int")
    got = sorted((r.frac_id, r.trial_i) for r in pending_trials(grid, done).collect())
    assert got == [(0, 0), (1, 1)]


def test_gvec_codec(spark):
    df = spark.createDataFrame([("[-0.04893315]",), ("[-inf]",), ("",), ("[0.1, -0.2]",)], "t string")
    got = [r.g for r in df.select(decode_gvec(F.col("t")).alias("g")).collect()]
    assert got[0] == [-0.04893315] and got[1] == [float("-inf")] and got[2] is None and got[3] == [0.1, -0.2]
    enc = df.select(encode_gvec(decode_gvec(F.col("t"))).alias("e")).collect()
    assert enc[1].e == "[-inf]"


def test_trials_round_trip_and_named_files(spark, tmp_path):
    res = spark.createDataFrame(
        [(0, 0.0031622776601683794, 0, 1, 3.59, True, [-0.0489]), (0, 0.0031622776601683794, 1, None, None, False, [float("-inf")])],
        "frac_id int, data_frac double, trial_i int, candidate_id int, performance double, passed_safety boolean, gvec array<double>",
    )
    out = str(tmp_path / "cells")
    write_trials(res, out)
    back = sorted(read_trials(spark, out).collect(), key=lambda r: r.trial_i)
    assert back[0].gvec == [-0.0489] and back[1].gvec == [float("-inf")] and back[1].performance is None
    named = tmp_path / "named"
    named.mkdir()
    (named / "data_frac_0.0032_trial_2.csv").write_text(
        "data_frac,trial_i,performance,passed_safety,gvec\n0.0031622776601683794,2,,False,[-inf]\n"
    )
    r = read_trials(spark, str(named), layout="named").first()
    assert r.file_trial_i == 2 and r.file_data_frac == pytest.approx(0.0032) and r.gvec == [float("-inf")]


def test_reconcile_keys_on_rounded_fraction(spark):
    from varguard.plans.experiment import reconcile

    a = spark.createDataFrame([(0.0031622776601683, 0, 1.0, True, [-0.1])], "data_frac double, trial_i int, performance double, passed_safety boolean, gvec array<double>")
    b = spark.createDataFrame([(0.0031622776601683794, 0, 1.0 + 4e-16, True, [-0.1])], "data_frac double, trial_i int, performance double, passed_safety boolean, gvec array<double>")
    row = reconcile(a, b).first()
    assert row.in_pooled and row.in_trials and row.match
