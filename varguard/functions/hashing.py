"""Deterministic per-unit hashing, shared by splits, shuffles and resampling.

A unit (row, group) is hashed as ``md5("<part>:<part>:...")``; the first 8 hex
digits give an unsigned 32-bit number and a uniform ``u`` in [0, 1). The
same numbers come out of any SQL engine that has md5, so every draw made here
can be checked by plain SQL. No state, no driver round trip: each row decides
for itself, so splits and draws are narrow (no shuffle) and reproducible when
a task is re-run after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def hash_key(*parts) -> Column:
    """``concat_ws(':', parts...)`` with every part cast to string."""
    return F.concat_ws(":", *[_part(p) for p in parts])


def hash32(*parts) -> Column:
    """Unsigned 32-bit number from the first 8 hex digits of the md5."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) from :func:`hash32`."""
    return hash32(*parts) / F.lit(TWO_POW_32)


def hash_order_key(*parts) -> Column:
    """Full md5 hex string: a seeded, reproducible sort key."""
    return F.md5(hash_key(*parts))


def hash60(*parts) -> Column:
    """Non-negative 60-bit id from the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 15), 16, 10).cast("bigint")


def hex_uniform(hex_col: Column, slot: int) -> Column:
    """Uniform in [0, 1) from 8 hex digits (slot 0..3) of an md5 hex string.

    One md5 per (unit, trial) yields four independent uniforms."""
    if not 0 <= slot <= 3:
        raise ValueError("slot must be 0..3")
    return F.conv(F.substring(hex_col, 1 + 8 * slot, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)
