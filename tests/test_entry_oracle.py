import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
import scripts.oracle_check as OC
from scripts.oracle_check import rows_of
from varguard.session import TABLES

# exact comparison: same doubles (sign of zero included) and same value types
OC.STRICT = True


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert df.columns == ["candidate_id", "n_rows", "loss", "n_groups", "n_dropped", "mean_vprob", "sd_vprob", "upper_bound", "passed"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, res.fetchall())


def _spark_type(dt):
    from pyspark.sql import types as T

    if isinstance(dt, T.ArrayType):
        return "list<" + _spark_type(dt.elementType) + ">"
    return {T.IntegerType: "int32", T.LongType: "int64", T.DoubleType: "float64", T.StringType: "string",
            T.BooleanType: "bool"}.get(type(dt), str(dt))


def _duck_type(t):
    t = str(t)
    if t.endswith("[]"):
        return "list<" + _duck_type(t[:-2]) + ">"
    return {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string", "BOOLEAN": "bool"}.get(t, t)


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not any(x in n for x in ("snk", "stream"))))
def test_column_types_match_sql_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    want = {c: _duck_type(t) for c, t in zip(rel.columns, rel.types)}
    got = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    assert got == want
