"""Mixing sources to target weights by Pfair scheduling.

Each source's texts, in a hashed order, form a stream that is cut into blocks of equal
size. Block j (from 1) of a source of weight w is released at slot
floor((j-1)/w) and due at slot ceil(j/w); earliest-deadline-first over these windows
puts exactly one block into every slot and keeps each source less than one block
from its target at all times.

Weights are exact fractions, never rounded to slots. A phase's slots are cut into pieces:
how many blocks of each source precede a cut follows from the weights alone, so
pieces are scheduled apart, by many tasks. When a source is
used up the rest go on in a new phase with their weights scaled up, and every
document keeps its place exactly once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from fractions import Fraction
from math import lcm
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a block, and least slots of a piece of the schedule.
BLOCK_CHARS, PERIOD = 4096, 1000
#: Rows that one sub-stream of a source holds on average; it is ordered in one task.
ROWS_PER_STREAM = 5000
#: Blocks of the schedule that are broadcast, about 50 MB; more are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def source_key(col: str = "source"):
    """A source's name; null is a source of its own, apart from all names."""
    return F.when(F.col(col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(col).cast("string")))


def root_weights(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> dict[str | None, float]:
    """Target weights proportional to the square root of each source's characters:
    small sources count for more than their size, large ones for less."""
    size = F.sum(F.coalesce(F.length(text_col), F.lit(0)))
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(size.alias("n")).collect()
    return {r["s"]: max(r["n"], 1.0) ** 0.5 for r in rows}


class Phase(NamedTuple):
    """Slots base..base+length-1, in pieces of ``step``. ``alive``, ``done`` and ``end``: indices of
    the sources with blocks left, their blocks before the phase and within it."""

    base: int
    length: int
    step: int
    alive: list[int]
    done: list[int]
    end: list[int]


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the same proportions."""
    exact = [Fraction(w) for w in weights]
    common = lcm(*[x.denominator for x in exact])
    return [int(x * common) for x in exact]


def due(j: int, m: int, total: int) -> int:
    """The deadline of block j (from 0) of a source of weight m / total."""
    return -(-(j + 1) * total // m)


def ceilings(slots: np.ndarray, m: list[int], total: int) -> np.ndarray:
    """ceil(slot * weight) for each slot and weight; where doubles come too near a whole number, in whole numbers."""
    x = np.multiply.outer(slots.astype(float), np.array([k / total for k in m]))
    out = np.ceil(x).astype(np.int64)
    for a, k in zip(*np.nonzero(np.abs(x - np.rint(x)) <= 1e-15 * x), strict=True):
        out[a, k] = -(-int(slots[a]) * m[k] // total)
    return out


def counts_before(slot: int, m: list[int], total: int) -> list[int]:
    """Blocks of each source that stand before ``slot``: floor or ceiling of slot * weight, and such that the
    slots on either side can be filled within all windows.

    The floors have to stand before it. Of the blocks whose windows contain the cut, those due first are
    added as long as, for every a, no more blocks than slots lie between a and the
    cut. Such sets are a matroid, so this order leaves as few early deadlines as any
    does; the fractional schedule satisfies all bounds, so a whole one does too.

    Not every a is looked at. Free at a are more slots than ``short`` less the fractions of a block (slot * weight above its
    floor) of the sources released before a. While these fractions are 1 at most together, the free slots, a whole number, are
    ``short`` at least, and no more blocks are added than that. So one source with a long window lengthens no scan.
    """
    low = [slot * k // total for k in m]
    short = slot - sum(low)
    across = [i for i, k in enumerate(m) if slot * k % total]
    if not short:
        return low
    release = {i: low[i] * total // m[i] for i in across}
    begin, skipped = slot, 0
    for i in sorted(across, key=release.__getitem__):
        skipped += slot * m[i] % total
        if skipped > total:
            begin = release[i]
            break
    room, known = [np.array([short])], np.array(low)
    for a in range(begin, slot, rows := max(1, (1 << 20) // len(m))):
        at = np.arange(a, min(a + rows, slot))
        room.append(slot - at - np.maximum(known - ceilings(at, m, total), 0).sum(axis=1))
    free = np.concatenate(room)  # at 0 for the whole, then for each slot from begin
    for i in sorted(across, key=lambda i: (due(low[i], m[i], total), i)):
        within = free[: max(1, release[i] - begin + 2)]
        if within.min() > 0:
            within -= 1
            low[i] += 1
    return low


def edf(m: list[int], total: int, start: int, stop: int, done: list[int], end: list[int] | None = None) -> list[int]:
    """The source in each slot from ``start`` to ``stop``: earliest deadline first among released blocks,
    ``done`` blocks before them and, where given, ``end`` at their end."""
    waiting = [(j * total // m[i], i, j) for i, j in enumerate(done) if end is None or j < end[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(start, stop):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(j, m[i], total) if end is None else min(due(j, m[i], total), stop), i, j))
        _, i, j = heapq.heappop(ready)
        out.append(i)
        if end is None or j + 1 < end[i]:
            heapq.heappush(waiting, ((j + 1) * total // m[i], i, j + 1))
    return out


def edf_period(slots: dict[str, int]) -> dict[str, list[int]]:
    """The slot of each block, where sources have whole slots of a period."""
    keys = sorted(slots)
    order = edf([slots[k] for k in keys], sum(slots.values()), 0, sum(slots.values()), [0] * len(keys))
    return {k: [at for at, i in enumerate(order) if keys[i] == k] for k in keys}


def plan(blocks: list[int], m: list[int], period: int) -> list[Phase]:
    """The phases: each lasts until a source has had its last block, so there are at
    most as many as sources."""
    done, base, out = [0] * len(blocks), 0, []
    while alive := [i for i, n in enumerate(blocks) if n > done[i]]:
        w, left, total = [m[i] for i in alive], [blocks[i] - done[i] for i in alive], sum(m[i] for i in alive)
        length = min(n * total // k for n, k in zip(left, w, strict=True))
        # twice the second longest window at least, so that a cut looks at no more slots than a piece has
        step = max(period, -(-2 * total // sorted(w)[min(1, len(w) - 1)]))
        if length > period:
            end = counts_before(length, w, total)
        else:
            end = np.bincount(edf(w, total, 0, length, [0] * len(w)), minlength=len(w)).tolist()
        for i, n in enumerate(left):  # one at most: a last block due with the next slot
            if end[i] < n and due(n - 1, w[i], total) <= length + 1:
                end[i], length = n, length + 1
                break
        out.append(Phase(base, length, step, alive, [done[i] for i in alive], end))
        for i, n in zip(alive, end, strict=True):
            done[i] += n
        base += length
    return out


def piece(phase: Phase, m: list[int], start: int) -> list[tuple[int, int, int, int, int]]:
    """``(source, block, release, deadline, slot)`` of the piece that begins at ``start``."""
    w, stop = [m[i] for i in phase.alive], min(start + phase.step, phase.length)
    total = sum(w)
    at = counts_before(start, w, total)
    end = phase.end if stop == phase.length else counts_before(stop, w, total)
    out = []
    for slot, i in enumerate(edf(w, total, start, stop, at, end), phase.base + start):
        j = at[i]
        at[i] += 1
        out.append((phase.alive[i], phase.done[i] + j, phase.base + j * total // w[i], phase.base + due(j, w[i], total), slot))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> tuple[list[tuple], list[tuple]]:
    """A small schedule as lists: rows ``(source, phase, first, last, blocks, length, base)``, as blocks
    first..last-1 of a source run in that phase, and ``(source, phase, index, place)``:
    block first+index at slot base + place."""
    keys = sorted(blocks)
    m = whole_weights([weights[k] for k in keys])
    spans, places = [], []
    for f, p in enumerate(plan([blocks[k] for k in keys], m, period)):
        spans += [(keys[i], f, d, d + n, max(n, 1), p.length, p.base) for i, d, n in zip(p.alive, p.done, p.end, strict=True)]
        first = dict(zip(p.alive, p.done, strict=True))
        for start in range(0, p.length, p.step):
            places += [(keys[i], f, j - first[i], slot - p.base) for i, j, _, _, slot in piece(p, m, start)]
    return spans, places


def schedule(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], period: int) -> DataFrame:
    """``(_mix_s, _mix_k, _mix_f, _mix_r, _mix_d, _mix_t)``: source, block, phase, release, deadline and slot of every block."""
    keys = sorted(blocks)
    m = whole_weights([weights[k] for k in keys])
    planned = plan([blocks[k] for k in keys], m, period)
    named = pa.array(keys, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, start in zip(batch["f"].to_pylist(), batch["start"].to_pylist(), strict=True):
                i, *rest = (pa.array(c, pa.int64()) for c in zip(*piece(planned[f], m, start), strict=True))
                columns = [named.take(i), rest[0], pa.array([f] * len(i), pa.int32()), *rest[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["_mix_s", "_mix_k", "_mix_f", "_mix_r", "_mix_d", "_mix_t"])

    rows = spark.createDataFrame([(f, p.length, p.step) for f, p in enumerate(planned)], "f int, length long, step long")
    starts = rows.select("f", F.explode(F.expr("sequence(0L, length - 1, step)")).alias("start"))
    pieces = sum(-(-p.length // p.step) for p in planned)
    return starts.repartition(max(1, min(pieces, 1024))).mapInArrow(run, "_mix_s string, _mix_k long, _mix_f int, _mix_r long, _mix_d long, _mix_t long")


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float],
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``block`` (of its source, from 0), ``phase``, ``release``,
    ``deadline`` and ``slot``, their names headed by ``prefix``; columns of
    those names in ``docs`` are replaced, all others stay.

    A document belongs to the block in which its first character lies; one
    longer than a block leaves the next blocks empty. Documents of a block
    stand in its slot in hashed order. Weights are by source, positive; a
    source without one gets the smallest given (1 if none is). A null source is a source of its
    own, null and empty texts have no characters and go with the block at which
    they fall. Repeated rows keep their number. An empty table gives an empty result.

    Each source is cut by hash of id and text into sub-streams, so that neither a source nor an id with a third
    of all rows is ordered by one task; only one row for each source reaches the driver.
    """
    spark = docs.sparkSession
    mine = [prefix + c for c in ("block", "phase", "release", "deadline", "slot")]
    kept = [c for c in docs.columns if c not in mine]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_mix_row"),  # so no name of theirs can clash
        source_key(source_col).alias("_mix_s"),
        F.xxhash64(F.col(id_col), F.lit("mix")).alias("_mix_h"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_mix_x"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("_mix_n"),
    )
    rows = docs.count()
    streams = max(1, -(-rows // ROWS_PER_STREAM))
    keyed = keyed.withColumn("_mix_b", F.pmod("_mix_x", F.lit(streams)))
    sizes = keyed.groupBy("_mix_s", "_mix_b").agg(F.sum("_mix_n").alias("n"))
    before = Window.partitionBy("_mix_s").orderBy("_mix_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_mix_s", "_mix_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_o"))
    totals = {r["_mix_s"]: r["n"] for r in sizes.groupBy("_mix_s").agg(F.sum("n").alias("n")).collect()}

    named = {"" if k is None else f"={k}": float(w) for k, w in weights.items()}
    if any(w <= 0 for w in named.values()):
        raise ValueError("weights must be positive")
    least = min(named.values(), default=1.0)
    # one block more than the characters fill, for empty texts at the very end
    blocks = {k: n // block_chars + 1 for k, n in totals.items()}
    slots = schedule(spark, blocks, {k: named.get(k, least) for k in blocks}, period)

    prior = Window.partitionBy("_mix_s", "_mix_b").orderBy("_mix_h", "_mix_x", "_mix_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("_mix_p", F.coalesce(F.sum("_mix_n").over(prior), F.lit(0)))
        .join(offsets, ["_mix_s", "_mix_b"])
        .withColumn("_mix_k", F.floor((F.col("_mix_p") + F.col("_mix_o")) / F.lit(block_chars)).cast("long"))
        .join(sized(slots, sum(blocks.values())), ["_mix_s", "_mix_k"])
    )
    return placed.select(
        *[F.col(f"_mix_row.`{c}`") for c in kept],
        *[F.col(c).alias(name) for c, name in zip(("_mix_k", "_mix_f", "_mix_r", "_mix_d", "_mix_t"), mine, strict=True)],
    )


def sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def in_mixed_order(mixed: DataFrame, columns: list[str], slot_col: str = "slot", id_col: str = "doc_id") -> DataFrame:
    """The documents in the order of their slots: files and rows of the table
    written next stand in that order."""
    order = [F.col(slot_col), F.xxhash64(F.col(id_col), F.lit("mix"))]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in columns])


def with_stored_place(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``, its rows' places from 0 in the order in which the table was written: files by part
    number, rows as they stand in a file. Spark itself reads files in the order of their sizes. Rows that
    don't come from files are numbered, with gaps, as their partitions stand."""
    try:
        kept = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.withColumn(name, F.monotonically_increasing_id())
    files = kept.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(files, key=lambda r: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", re.sub(r"(part-\d+)-.*?([-.]c\d+)", r"\1\2", r["_file"]))]):
        starts.append((r["_file"], total))
        total += r["n"]
    first = docs.sparkSession.createDataFrame(starts, "_file string, _first long")
    return kept.join(F.broadcast(first), "_file").withColumn(name, F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")
