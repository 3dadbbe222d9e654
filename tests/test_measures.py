import random

import pytest
from pyspark.sql import functions as F

from varguard.operators.measures import cross_entropy, perf_eval, summarise, summarise_batched, vprob


def _members(spark, rows):
    return spark.createDataFrame(rows, "group_id long, pos long, logit double, candidate_id int")


def test_singleton_group_dropped_and_counted(spark):
    m = _members(spark, [(1, 0, 0.3, 0), (2, 0, 0.1, 0), (2, 1, 0.5, 0), (3, 0, 1.0, 0), (3, 1, 1.0, 0)])
    v = {r.group_id: r for r in vprob(m).collect()}
    assert v[1].vprob is None and v[1].n_members == 1
    assert v[3].vprob == 0.0  # identical scores
    s = summarise(vprob(m), "vprob").first()
    assert s.n == 2 and s.n_dropped == 1


def test_batched_summary_equals_unbatched(spark):
    rnd = random.Random(7)
    rows = [(0, g, rnd.random() * 0.1 if g % 11 else None) for g in range(200)]
    df = spark.createDataFrame(rows, "candidate_id int, g long, v double").withColumn("batch_id", F.floor(F.col("g") / 8))
    a = summarise(df, "v").first()
    b = summarise_batched(df, "v", "batch_id").first()
    assert (a.n, a.n_dropped) == (b.n, b.n_dropped)
    assert a.mean == pytest.approx(b.mean, rel=1e-12)
    assert a.sd == pytest.approx(b.sd, rel=1e-10)


def test_cross_entropy_and_perf_eval(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 0, 0.0)], "candidate_id int, label int, logit double")
    ce = cross_entropy(df).first()
    assert ce.loss == pytest.approx(0.6931471805599443, rel=1e-9)
    probs = df.withColumn("prob", F.lit(0.5))
    assert perf_eval(probs).first().performance == pytest.approx(ce.loss, rel=1e-12)


def test_perf_eval_rejects_non_probabilities(spark):
    df = spark.createDataFrame([(0, 1, 1.5)], "candidate_id int, label int, prob double")
    with pytest.raises(Exception):
        perf_eval(df).collect()
