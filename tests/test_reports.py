import math

import pytest
from pyspark.sql import functions as F

from varguard.plans.experiment import abs_size, failure_rate, learning_curve, solution_rate

NEG_INF = float("-inf")
SCHEMA = "frac_id int, data_frac double, trial_i int, performance double, passed_safety boolean, gvec array<double>"


def _results(spark):
    # fraction 0: 4 trials, 2 passed (losses 3.0, 5.0), none violates on full data
    # fraction 1: 4 trials, all passed, one with true g > 0
    rows = [
        (0, 0.1, 0, 3.0, True, [-0.04]),
        (0, 0.1, 1, None, False, [NEG_INF]),
        (0, 0.1, 2, 5.0, True, [-0.01]),
        (0, 0.1, 3, None, False, [NEG_INF]),
        (1, 1.0, 0, 1.0, True, [-0.02]),
        (1, 1.0, 1, 1.0, True, [0.003]),
        (1, 1.0, 2, 2.0, True, [-0.03]),
        (1, 1.0, 3, 2.0, True, [-0.001]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_learning_curve_uses_passed_trials_only(spark):
    lc = {r.frac_id: r for r in learning_curve(_results(spark)).collect()}
    assert lc[0].n_passed == 2 and lc[0].mean_performance == pytest.approx(4.0)
    assert lc[0].se_performance == pytest.approx(math.sqrt(2.0) / math.sqrt(2.0))
    assert lc[1].mean_performance == pytest.approx(1.5)


def test_solution_and_failure_rates(spark):
    sr = {r.frac_id: r for r in solution_rate(_results(spark)).collect()}
    assert sr[0].solution_rate == 0.5 and sr[0].se_solution_rate == pytest.approx(math.sqrt(0.25 / 4))
    assert sr[1].solution_rate == 1.0 and sr[1].se_solution_rate == 0.0
    fr = {r.frac_id: r for r in failure_rate(_results(spark)).collect()}
    assert fr[0].failure_rate == 0.0 and fr[1].failure_rate == 0.25


def test_abs_size(spark):
    got = {r.frac_id: r.n_points for r in abs_size(_results(spark), F.lit(400.0)).collect()}
    assert got == {0: 40.0, 1: 400.0}
