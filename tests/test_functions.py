import math

import pytest
from pyspark.sql import functions as F

from varguard.functions.stats import expansion_coefficients, t_ppf, t_table
from varguard.operators.resample import poisson_cdf


def test_t_quantiles_known_values():
    # Student t 95 % quantiles from published tables
    assert t_ppf(0.95, 1) == pytest.approx(6.313752, abs=1e-6)
    assert t_ppf(0.95, 10) == pytest.approx(1.812461, abs=1e-6)
    assert t_ppf(0.95, 30) == pytest.approx(1.697261, abs=1e-6)
    assert t_ppf(0.975, 5) == pytest.approx(2.570582, abs=1e-6)


def test_expansion_matches_table_edge():
    x, g1, g2, g3, g4 = expansion_coefficients(0.95)
    nu = 100
    approx = x + g1 / nu + g2 / nu**2 + g3 / nu**3 + g4 / nu**4
    assert approx == pytest.approx(t_table(0.95)[-1], abs=1e-9)


def test_t_quantile_column(spark):
    from varguard.functions.stats import t_quantile

    rows = spark.range(0, 300).select(F.col("id"), t_quantile(F.col("id"), 0.95).alias("t")).collect()
    assert rows[0].t is None  # nu = 0: undefined
    assert rows[1].t == pytest.approx(6.313752, abs=1e-6)
    assert rows[250].t == pytest.approx(t_ppf(0.95, 250), abs=1e-8)
    vals = [r.t for r in rows[1:]]
    assert all(a > b for a, b in zip(vals, vals[1:]))  # strictly decreasing in nu


def test_sigmoid_and_loss_edges(spark):
    from varguard.functions.scalar import log_loss, sigmoid

    df = spark.createDataFrame([(800.0, 1), (-800.0, 1), (-800.0, 0), (800.0, 0), (0.0, 1)], "z double, y int")
    out = df.select(sigmoid(F.col("z")).alias("p"), log_loss("y", sigmoid(F.col("z"))).alias("l")).collect()
    assert out[0].p == 1.0 and out[1].p == 0.0
    assert out[1].l == pytest.approx(-math.log(1e-15), rel=1e-12)  # 34.5388
    assert out[1].l <= 34.54
    assert out[2].l == pytest.approx(0.0, abs=1e-12)
    assert out[4].l == pytest.approx(math.log(2.0), rel=1e-12)


def test_hash_uniform_is_deterministic_and_in_range(spark):
    from varguard.functions.hashing import hash32, uniform

    df = spark.range(1000).select(uniform(F.lit(42), F.col("id")).alias("u"), hash32(F.lit(42), F.col("id")).alias("h"))
    rows = df.collect()
    again = df.collect()
    assert rows == again
    assert all(0.0 <= r.u < 1.0 for r in rows)
    assert all(0 <= r.h < 2**32 for r in rows)


def test_poisson_cdf():
    cdf = poisson_cdf()
    assert cdf[0] == pytest.approx(math.exp(-1))
    assert 1 - cdf[-1] < 2**-33
    assert all(a < b for a, b in zip(cdf, cdf[1:]))
