"""Ragged text groups: flatten, re-nest, size profile, chop, hard groups,
counterfactual expansion.

Long form ``(group_id, pos, text)`` is the working shape; arrays appear only
at the edges (reading array input, re-nesting results of bounded groups).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRONOUN_SLOT, PRONOUN_TERMS


def flatten_groups(df: DataFrame, group_col: str = "group_id", array_col: str = "text_groups") -> DataFrame:
    """One row per member: ``(group_id, pos, n_members, text)``; pos is 0-based."""
    return df.select(
        group_col,
        F.size(array_col).alias("n_members"),
        F.posexplode(array_col).alias("pos", "text"),
    ).select(group_col, "pos", "n_members", "text")


def check_group_bound(df: DataFrame, group_col: str, max_members: int) -> None:
    """Fail fast when a group is too large to gather into one array (a map-side
    combined count per group; only the largest size reaches the driver)."""
    biggest = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if biggest is not None and biggest > max_members:
        raise ValueError(
            f"a group has {biggest} members (limit {max_members}); keep it in long form "
            "(group_id, pos, value) instead of nesting it into one array"
        )


def renest(
    df: DataFrame,
    value_col: str,
    group_col: str = "group_id",
    pos_col: str = "pos",
    out_col: str | None = None,
    max_members: int | None = None,
) -> DataFrame:
    """Back to one array per group, members in ``pos`` order.

    An array is one value of one row, so its group is built in one task: meant
    for bounded groups (sentence sets, conversations); large ones stay in long
    form. No group is refused unless ``max_members`` asks for a check first."""
    if max_members is not None:
        check_group_bound(df, group_col, max_members)
    out_col = out_col or f"{value_col}s"
    return df.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos_col, value_col))), lambda s: s[value_col]).alias(out_col)
    )


def nest_texts(
    df: DataFrame, group_col: str = "group_id", pos_col: str = "pos", text_col: str = "text", max_members: int | None = None
) -> DataFrame:
    """Long form -> ``(group_id, n_members, text_groups)`` (bounded groups only)."""
    nested = renest(df, text_col, group_col, pos_col, "text_groups", max_members)
    return nested.select(group_col, F.size("text_groups").alias("n_members"), "text_groups")


def chunk_groups(
    df: DataFrame, value_col: str, size: int = 1024, max_bytes: int | None = None, group_col: str = "group_id", pos_col: str = "pos", out_col: str | None = None
) -> DataFrame:
    """Ragged groups as arrays of bounded size: ``(group_id, chunk, part, first_pos, n_members, <value>s)``.

    Chunk i has the members at positions i * size to (i + 1) * size - 1 (positions may have gaps), so a member's chunk
    needs no look at its group: a group of any size is built by as many tasks as it has chunks. With ``max_bytes`` a chunk of
    strings falls into parts whose members begin within so many bytes of each other. In the order of (chunk, part) the
    arrays together are the group's; members at NULL positions are a chunk of their own, first in order."""
    out_col = out_col or f"{value_col}s"
    keyed = df.select(group_col, pos_col, value_col, F.floor(F.col(pos_col) / F.lit(size)).cast("long").alias("chunk"))
    part = F.lit(0)
    if max_bytes is not None:
        before = Window.partitionBy(group_col, "chunk").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, -1)
        part = F.floor(F.coalesce(F.sum(F.coalesce(F.octet_length(value_col), F.lit(0))).over(before), F.lit(0)) / F.lit(max_bytes)).cast("int")
    keyed = keyed.withColumn("part", part)
    return keyed.groupBy(group_col, "chunk", "part").agg(
        F.min(pos_col).alias("first_pos"),
        F.count(F.lit(1)).alias("n_members"),
        F.array_sort(F.collect_list(F.struct(pos_col, value_col))).alias("_ms"),
    ).select(group_col, "chunk", "part", "first_pos", "n_members", F.transform("_ms", lambda s: s[pos_col]).alias("positions"), F.transform("_ms", lambda s: s[value_col]).alias(out_col))


def flatten_chunks(chunks: DataFrame, array_col: str, value_col: str, group_col: str = "group_id", pos_col: str = "pos") -> DataFrame:
    """The inverse of :func:`chunk_groups`: ``(group_id, pos, <value>)``, one row per member, without a shuffle."""
    pairs = F.arrays_zip(F.col("positions").alias("p"), F.col(array_col).alias("v"))
    return chunks.select(group_col, F.explode(pairs).alias("_m")).select(group_col, F.col("_m.p").alias(pos_col), F.col("_m.v").alias(value_col))


def group_sizes(df: DataFrame, group_col: str = "group_id") -> DataFrame:
    """Size profile: ``(n_members, n_groups)``."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_members"))
    return sizes.groupBy("n_members").agg(F.count(F.lit(1)).alias("n_groups"))


def chop_groups(df: DataFrame, k: int, group_col: str = "group_id", pos_col: str = "pos") -> DataFrame:
    """Keep the first k members of each group (by pos); adds ``rank`` (1-based).

    ``row_number() <= k`` is planned with a partial window-group limit before
    the shuffle, so a huge group ships at most k rows per map task."""
    w = Window.partitionBy(group_col).orderBy(pos_col)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Accuracy of the quantile sketch (its rank error is 1 / SKETCH of the rows), and values that may reach the driver.
SKETCH, NEAR_VALUES = 1000, 10_000


def exact_quantile(df: DataFrame, col: str, p: float, near_values: int = NEAR_VALUES) -> float | None:
    """Exact quantile with linear interpolation (like SQL percentile_cont), without a sort of all values.

    A mergeable sketch (``percentile_approx``) brackets the two ranks, counts of what lies below and inside the bracket place
    them, and only what is inside is looked at again, until ``near_values`` distinct values at most are left: those come to the
    driver with their counts. Each round keeps a few thousandths of the rows. NULLs are left out; no value gives None."""
    vals = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    v, n = F.col("_v"), vals.count()
    if n == 0:
        return None
    h = p * (n - 1)
    lo, hi = int(h // 1), min(int(h // 1) + 1, n - 1)
    below, inside, margin = 0, n, 2.0 / SKETCH
    while inside > near_values:
        shares = [max(0.0, (lo - below) / inside - margin), min(1.0, (hi + 1 - below) / inside + margin)]
        a, b = vals.agg(F.percentile_approx(v, shares, 10 * SKETCH).alias("q")).first()["q"]
        found = vals.agg(F.count(F.when(v < a, 1)).alias("less"), F.count(F.when((v >= a) & (v <= b), 1)).alias("m")).first()
        if not below + found["less"] <= lo or not hi < below + found["less"] + found["m"]:
            margin *= 2  # the sketch missed
            continue
        below += found["less"]
        vals = vals.filter((v >= a) & (v <= b))
        if a == b:
            return a
        if found["m"] == inside:  # many rows at few values: equal ones are counted, not sorted
            break
        inside = found["m"]
    got, before = {}, below
    for r in vals.groupBy("_v").count().orderBy("_v").collect():
        for rank in (lo, hi):
            if before <= rank < before + r["count"]:
                got[rank] = r["_v"]
        before += r["count"]
    return got[lo] + (h - lo) * (got[hi] - got[lo])


def hard_groups(per_group: DataFrame, value_col: str, q: float = 0.9) -> DataFrame:
    """Groups whose measure is at or above its q-quantile over groups."""
    # the per-group table is small next to its members: write it once to the
    # shared checkpoint folder so the quantile's jobs do not re-read the members
    per_group = per_group.checkpoint()
    cut = exact_quantile(per_group, value_col, q)
    if cut is None:
        return per_group.limit(0)
    return per_group.filter(F.col(value_col) >= F.lit(cut))


def expand_terms(
    df: DataFrame,
    text_col: str = "text",
    key_col: str = "doc_id",
    slot: str = PRONOUN_SLOT,
    terms: Sequence[str] = tuple(PRONOUN_TERMS),
) -> DataFrame:
    """Counterfactual groups: rows whose text holds the word ``slot`` (any case)
    become a group of len(terms) texts, each with every occurrence replaced.

    ``(group_id, pos, term, text)``; group_id = the source key. The term list is
    a literal array exploded in place (no join)."""
    pattern = f"(?i)\\b{slot}\\b"
    hits = df.filter(F.col(text_col).rlike(pattern))
    arr = F.array(*[F.lit(t) for t in terms])
    return hits.select(F.col(key_col).alias("group_id"), F.posexplode(arr).alias("pos", "term"), text_col).select(
        "group_id", "pos", "term", F.regexp_replace(F.col(text_col), pattern, F.col("term")).alias("text")
    )
