"""Plain-SQL (DuckDB dialect) twins of the stand-ins and operators.

They are written relationally (unnest + join + GROUP BY), independently of
the Spark plans, and serve as the correctness oracle at sf0.01. Constants
come from ``config`` so both sides use the same parameters.
"""

from __future__ import annotations

from ..config import CANDIDATE_WEIGHTS, FRAC_DATA_IN_SAFETY, LEXICON, LEXICON_BIAS, SEED, STABILITY_CONST
from ..functions.stats import t_quantile_sql

C = repr(STABILITY_CONST)


def hash32(*parts: str) -> str:
    """SQL: unsigned 32-bit number from md5 of ':'-joined parts (SQL expressions)."""
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def uniform(*parts: str) -> str:
    return f"(CAST({hash32(*parts)} AS DOUBLE) / 4294967296.0)"


def derive_split(key: str, train: float = 0.8, dev: float = 0.1) -> str:
    u = uniform(SEED_S, "'dataset'", key)
    return f"(CASE WHEN {u} < {train!r} THEN 'train' WHEN {u} < {train + dev!r} THEN 'dev' ELSE 'test' END)"


def safety_part(key: str, frac: float = FRAC_DATA_IN_SAFETY, *extra: str) -> str:
    u = uniform(SEED_S, "'split'", *extra, key)
    return f"(CASE WHEN {u} < {frac!r} THEN 'safety' ELSE 'candidate' END)"


def order_key(key: str, salt: str = "order") -> str:
    return f"md5(concat_ws(':', {SEED_S}, {q(salt)}, {key}))"


def hash60(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15)) AS BIGINT)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SEED_S = q(str(SEED))


PRIMARY = (
    "SELECT d.doc_id, d.text, CAST(l.toxic AS INTEGER) AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)


def doc_groups(*by: str) -> str:
    key = " || ':' || ".join(f"(CASE WHEN {c} IS NULL THEN '-' ELSE length({c}) || '=' || {c} END)" for c in by)
    return f"SELECT CAST('0x' || substr(md5('group:' || {key}), 1, 15) AS BIGINT) AS group_id, doc_id AS pos, text FROM documents"


GROUPS_LS = doc_groups("lang", "source")
GROUPS_SRC = doc_groups("source")
GROUPS_CONV = "SELECT conv_id AS group_id, turn AS pos, text FROM conversations"


def weights_values(weights=tuple(CANDIDATE_WEIGHTS), bias: float = LEXICON_BIAS, terms=tuple(LEXICON)) -> str:
    """``(candidate_id, term, weight)`` rows; term NULL is the bias."""
    rows = []
    for cid, w in enumerate(weights):
        rows.append(f"({cid}, CAST(NULL AS VARCHAR), CAST({float(bias)!r} AS DOUBLE))")
        rows.extend(f"({cid}, {q(t)}, CAST({float(w)!r} AS DOUBLE))" for t in terms)
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS w(candidate_id, term, weight)"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z]+'), lambda t: t <> '')"


def scored(base: str, keys: list[str], extra: list[str], weights: str) -> str:
    """SQL producing ``keys + extra + candidate_id, logit`` from ``base``
    (which has keys, extra and text)."""
    k = ", ".join(keys)
    kb = ", ".join(f"b.{c}" for c in keys + extra)
    on = " AND ".join(f"b.{c} = s.{c}" for c in keys)
    return f"""
    (WITH base AS ({base}),
    w AS ({weights}),
    toks AS (SELECT {k}, unnest({tokens_sql('text')}) AS term FROM base),
    sums AS (SELECT {", ".join("toks." + c for c in keys)}, w.candidate_id, sum(w.weight) AS s
             FROM toks JOIN w ON toks.term = w.term GROUP BY ALL),
    bias AS (SELECT candidate_id, sum(weight) AS b FROM w WHERE term IS NULL GROUP BY candidate_id)
    SELECT {kb}, bias.candidate_id, bias.b + coalesce(s.s, 0.0) AS logit
    FROM base b CROSS JOIN bias LEFT JOIN sums s ON {on} AND s.candidate_id = bias.candidate_id)"""


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def log_loss(y: str, p: str) -> str:
    return f"(-CAST({y} AS DOUBLE) * ln({p} + {C}) - (1.0 - CAST({y} AS DOUBLE)) * ln(1.0 - {p} + {C}))"


def t_q(nu: str, p: float) -> str:
    return t_quantile_sql(nu, p)

