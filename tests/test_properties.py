import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varguard.functions.stats import t_ppf
from varguard.operators.measures import summarise, summarise_batched
from varguard.plans.catalog import positive_zero_rounding


@settings(max_examples=25, deadline=None)
@given(st.floats(min_value=0.5, max_value=0.999), st.integers(min_value=1, max_value=200))
def test_t_quantile_monotone(p, nu):
    assert t_ppf(p, nu) >= t_ppf(p, nu + 1) - 1e-12
    assert t_ppf(min(p + 0.0005, 0.9995), nu) >= t_ppf(p, nu) - 1e-12


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(min_value=-1e-3, max_value=1e-3, allow_nan=False), min_size=1, max_size=6))
def test_positive_zero_rounding_keeps_values(xs):
    con = duckdb.connect()
    cols = ", ".join(f"round(CAST({x!r} AS DOUBLE), 6) AS c{i}" for i, x in enumerate(xs))
    plain = con.execute(f"SELECT {cols}").fetchone()
    fixed = con.execute(positive_zero_rounding(f"SELECT {cols}")).fetchone()
    for a, b in zip(plain, fixed):
        assert a == b
        assert math.copysign(1.0, b) == 1.0 or b != 0.0
    again = positive_zero_rounding(positive_zero_rounding("SELECT round(x, 6)"))
    assert again.count("+ 0.0") == 2  # nesting is explicit, never silently dropped


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.floats(min_value=0.0, max_value=0.25)), min_size=2, max_size=60),
    st.integers(min_value=1, max_value=9),
)
def test_batched_summary_property(spark, values, batch):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "candidate_id int, g long, v double")
    df = df.withColumn("batch_id", F.floor(F.col("g") / batch))
    a, b = summarise(df, "v").first(), summarise_batched(df, "v", "batch_id").first()
    assert (a.n, a.n_dropped) == (b.n, b.n_dropped)
    if a.n:
        assert b.mean == pytest.approx(a.mean, rel=1e-9, abs=1e-15)
    if a.n >= 2:
        assert b.sd == pytest.approx(a.sd, rel=1e-6, abs=1e-12)
