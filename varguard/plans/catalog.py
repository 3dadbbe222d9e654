"""Registry of the queries run by the driver, with their SQL oracles.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, sql or None)``.
Queries read the given test tables (or data Spark derives from them) in
full; every double is rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def positive_zero_rounding(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``.

    Spark rounds through decimals and never returns -0.0; DuckDB's round of a
    tiny negative number does. Adding +0.0 turns -0.0 into 0.0 and changes no
    other value, so both engines print the same numbers."""
    out, i, token = [], 0, "round("
    while True:
        j = sql.find(token, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i : j + len(token)])
            i = j + len(token)
            continue
        depth, k = 0, j + len(token) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounding(sql[j + len(token) : k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = positive_zero_rounding(sql() if callable(sql) else sql)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_core, queries_experiment, queries_measures, queries_prep, queries_runs  # noqa: F401
