from pyspark.sql import functions as F

from varguard.sources.results import write_trials
from varguard.streaming.pool import start_pooling, start_rate_report

SCHEMA = "frac_id int, data_frac double, trial_i int, candidate_id int, performance double, passed_safety boolean, gvec array<double>"


def _cells(spark, frac_id, passed):
    rows = [(frac_id, 0.1 * (frac_id + 1), t, 0 if p else None, 1.0 if p else None, p, [-0.01] if p else [float("-inf")])
            for t, p in enumerate(passed)]
    return spark.createDataFrame(rows, SCHEMA)


def test_pooling_is_incremental_and_exactly_once(spark, tmp_path):
    cells, pooled = str(tmp_path / "cells"), str(tmp_path / "pooled")
    ckpt, rep, rep_ckpt = str(tmp_path / "ckpt"), str(tmp_path / "rate"), str(tmp_path / "rate-ckpt")
    write_trials(_cells(spark, 0, [True, False, True]), cells, mode="append")
    start_pooling(spark, cells, pooled, ckpt).awaitTermination()
    start_rate_report(spark, cells, rep, rep_ckpt).awaitTermination()
    assert spark.read.parquet(pooled).count() == 3
    # a second wave of cells, then a restart from the same checkpoints
    write_trials(_cells(spark, 1, [True, True]), cells, mode="append")
    start_pooling(spark, cells, pooled, ckpt).awaitTermination()
    start_rate_report(spark, cells, rep, rep_ckpt).awaitTermination()
    got = spark.read.parquet(pooled)
    assert got.count() == 5
    assert got.select("frac_id", "trial_i").distinct().count() == 5
    assert got.filter(F.col("gvec")[0] == float("-inf")).count() == 1
    rates = {r.frac_id: (r.n_trials, r.solution_rate) for r in spark.read.parquet(rep).collect()}
    assert rates[0][0] == 3 and abs(rates[0][1] - 2 / 3) < 1e-12
    assert rates[1] == (2, 1.0)
