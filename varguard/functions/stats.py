"""Student-t quantiles as Column expressions.

The degrees of freedom are data (n - 1 of a grouped count), so the quantile
is evaluated per row on the executors:

* for 1 <= nu <= TABLE_MAX it is looked up in a literal array built from an
  exact inversion of the t distribution function;
* above that the Abramowitz & Stegun 26.7.5 expansion in 1/nu (four terms)
  around the normal quantile is used; at nu > TABLE_MAX its error is far
  below 1e-9.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_MAX = 100


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_cdf(t: float, nu: float) -> float:
    tail = 0.5 * betainc(nu / 2.0, 0.5, nu / (nu + t * t))
    return 1.0 - tail if t >= 0 else tail


def t_ppf(p: float, nu: float) -> float:
    """Quantile of Student's t by bisection on the exact distribution function."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must lie in (0, 1)")
    if p < 0.5:
        return -t_ppf(1.0 - p, nu)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, nu) < p:
        lo, hi = hi, hi * 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, nu) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


@lru_cache(maxsize=32)
def t_table(p: float, table_max: int = TABLE_MAX) -> tuple:
    """Exact quantiles for nu = 1..table_max."""
    return tuple(t_ppf(p, nu) for nu in range(1, table_max + 1))


def expansion_coefficients(p: float) -> tuple:
    """(x, g1(x), g2(x), g3(x), g4(x)) of A&S 26.7.5 at x = z_p."""
    x = NormalDist().inv_cdf(p)
    g1 = (x ** 3 + x) / 4.0
    g2 = (5 * x ** 5 + 16 * x ** 3 + 3 * x) / 96.0
    g3 = (3 * x ** 7 + 19 * x ** 5 + 17 * x ** 3 - 15 * x) / 384.0
    g4 = (79 * x ** 9 + 776 * x ** 7 + 1482 * x ** 5 - 1920 * x ** 3 - 945 * x) / 92160.0
    return x, g1, g2, g3, g4


def double_array(values) -> Column:
    """Literal ``ARRAY<DOUBLE>`` built from SQL text: one call to the JVM
    instead of one per element (``D`` keeps the literals double)."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def t_quantile(nu, p: float) -> Column:
    """Column: t quantile at probability p with ``nu`` degrees of freedom.

    NULL when nu < 1 (fewer than two observations).
    """
    nu = F.col(nu) if isinstance(nu, str) else nu
    nu_i = nu.cast("int")
    table = double_array(t_table(p))
    x, g1, g2, g3, g4 = expansion_coefficients(p)
    v = nu.cast("double")
    approx = (
        F.lit(x) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v) + F.lit(g4) / (v * v * v * v)
    )
    return (
        F.when(nu.isNull() | (nu < 1), F.lit(None).cast("double"))
        .when(nu <= TABLE_MAX, F.element_at(table, nu_i))
        .otherwise(approx)
    )


def t_quantile_sql(nu_sql: str, p: float) -> str:
    """The same quantile as DuckDB SQL text (for oracle queries)."""
    table = ", ".join(repr(v) for v in t_table(p))
    x, g1, g2, g3, g4 = expansion_coefficients(p)
    v = f"CAST({nu_sql} AS DOUBLE)"
    approx = (
        f"({x!r} + {g1!r} / {v} + {g2!r} / ({v}*{v}) + {g3!r} / ({v}*{v}*{v}) + {g4!r} / ({v}*{v}*{v}*{v}))"
    )
    return (
        f"(CASE WHEN ({nu_sql}) IS NULL OR ({nu_sql}) < 1 THEN CAST(NULL AS DOUBLE) "
        f"WHEN ({nu_sql}) <= {TABLE_MAX} THEN ([{table}])[CAST({nu_sql} AS INTEGER)] "
        f"ELSE {approx} END)"
    )
