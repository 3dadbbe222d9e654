"""Embedding near-dedup by E8 lattice hashing.

In each of several tables a random projection maps a vector to 8 dimensions,
where it is decoded to the nearest point of the E8 lattice: its cell. A vector probes its own
cell and the neighbouring cells nearest to it. Only ids and 128-bit sketches are sent to the cells; vectors that meet are compared by their sketches,
and what may reach the cosine is verified on the vectors themselves in double precision.

Equal vectors (known by a digest of their components) are one node. A cell with many nodes is split and its
probes are sent to each part, so no task holds a cell whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, seed64, written
from .e8 import decode, neighbours, shortest_vectors

#: Neighbouring cells probed in each table, the projection's scale in lattice units, and the chance that a pair just at the
#: cosine meets in some table. Together they give the number of tables: 6 for a cosine of 0.9, so 24 rows a vector.
PROBES, SCALE, RECALL = 3, 0.7, 0.97
#: Bits of a sketch, and the chance that a pair just at the cosine differs in more of them than are allowed.
SKETCH, SKETCH_MISS = 128, 1e-4
#: Nodes of a cell that one task holds.
CELL_ROWS = 4096
#: Large cells that are broadcast, 16 bytes each.
BROADCAST_CELLS = 1 << 20
#: Candidates compared at a time.
STEP = 1 << 18


def tables_for(cosine: float, probes: int, scale: float, recall: float = RECALL) -> int:
    """Tables that let a pair of this cosine meet with probability ``recall``. The chance in one table is that of two
    correlated normal points in 8 dimensions, whatever the vectors' length; it is measured on 20,000 drawn pairs."""
    rng = np.random.default_rng(seed64("recall"))
    x, y = rng.normal(size=(2, 20_000, 8))
    x, y = x * scale, (cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y) * scale
    shell, cells = shortest_vectors(), [decode(x), decode(y)]
    meets = (cells[0] == cells[1]).all(axis=1)
    for a, own, other in ((x, *cells), (y, *cells[::-1])):
        meets |= (neighbours(a, own, probes, shell) == other[:, None, :]).all(axis=2).any(axis=1)
    missed = 1 - meets.mean()
    return 1 if missed <= 1 - recall else int(np.ceil(np.log(1 - recall) / np.log(missed)))


def projection(table: int, dim: int, scale: float) -> np.ndarray:
    return np.random.default_rng(seed64("e8", table, dim)).normal(size=(dim, 8)) * scale


def cell_key(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit key of lattice points (..., 8); twice a point is whole."""
    h = np.full(points.shape[:-1], seed64("cell", table, dim), np.uint64)
    for x in np.moveaxis(np.rint(points * 2).astype(np.int64).astype(np.uint64), -1, 0):
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def sketches(v: np.ndarray, dim: int) -> np.ndarray:
    """(n, 2) whole numbers: on which side of ``SKETCH`` random planes a vector lies."""
    planes = np.random.default_rng(seed64("sketch", dim)).normal(size=(dim, SKETCH))
    return np.packbits(v @ planes >= 0, axis=1).view(np.int64)


def sketch_bits(cosine: float) -> int:
    """Differing bits that a pair of this cosine or more exceeds with a chance of ``SKETCH_MISS`` at most."""
    p, below = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 0.0
    for bits in range(SKETCH + 1):
        below += math.comb(SKETCH, bits) * p**bits * (1 - p) ** (SKETCH - bits)
        if below >= 1 - SKETCH_MISS:
            break
    return bits


def lattice_rows(nodes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """``(key, node, s0, s1)``: for each table a row at the node's own cell, and a probe at each neighbouring one. A cell's
    key is even, a probe's key is the cell's plus 1. Rows carry the sketch, never the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shell = shortest_vectors()
        for batch in batches:
            column = batch["v"]
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids = batch["node"].to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                v = flat[starts[at][:, None] + np.arange(dim)]
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                rest = [pa.array(np.ascontiguousarray(x)) for x in (ids[at], *sketches(v, dim).T)]
                for t in range(tables):
                    x = v @ projection(t, dim, scale)
                    own = decode(x)
                    near = own[:, None, :]
                    if probes:
                        near = np.concatenate([near, neighbours(x, own, probes, shell)], axis=1)
                    keys = cell_key(near, t, dim) & np.int64(-2)
                    for j in range(probes + 1):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, j] | np.int64(j > 0)), *rest], names=["key", "node", "s0", "s1"])

    return nodes.select("node", "v").mapInArrow(run, "key long, node long, s0 long, s1 long")


def split_cells(rows: DataFrame, own: DataFrame, most_cells: int, cell_rows: int) -> DataFrame:
    """``rows`` with cells of more than ``cell_rows`` nodes (counted on ``own``) in parts, each with a key of its own. A probe of
    such a cell goes to every part; a node stands in one part and probes the others. There are at most ``most_cells`` such
    cells; up to ``BROADCAST_CELLS`` they are broadcast, more are joined by shuffle."""
    large = own.groupBy("key").count().where(F.col("count") > cell_rows)
    large = large.select(F.col("key").alias("cell"), F.ceil(F.col("count") * 2 / cell_rows).cast("int").alias("parts")).checkpoint()
    if most_cells <= BROADCAST_CELLS:
        large = F.broadcast(large)
    probe = F.col("key").bitwiseAND(F.lit(1).cast("long"))
    joined = rows.join(large, F.col("key") - probe == F.col("cell"), "left")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    asks = F.when((probe == 0) & (F.col("part") == F.col("mine")), F.lit(0)).otherwise(F.lit(1)).cast("long")
    part_key = F.xxhash64("cell", "part").bitwiseAND(F.lit(-2).cast("long")) + asks
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = joined.select("*", mine.alias("mine"), F.explode(parts).alias("part"))
    return dealt.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(part_key).alias("key"), "node", "s0", "s1")


def meeting_pairs(rows: DataFrame, cosine: float) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of nodes that meet in a cell and whose sketches differ in few enough bits."""
    most = sketch_bits(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)  # the last cell's own rows: a cell may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch[c].to_numpy() for c in ("key", "node", "s0", "s1")])
            rows = np.concatenate([held, rows], axis=1)
            probe = rows[0] & 1
            rows[0] -= probe
            key, node, s0, s1 = rows
            cell = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            own = np.flatnonzero(probe == 0)
            count = np.bincount(cell[own], minlength=cell[-1] + 1)
            first = np.cumsum(count) - count  # own rows precede a cell's probes, so they are in order of cells
            # a new node meets the own rows before it, a probe all own rows of its cell
            asks = np.arange(held.shape[1], len(key))
            each = count[cell]
            each[own] = np.arange(len(own)) - first[cell[own]]
            each = each[asks]
            for lo, hi in steps(each):
                left = np.repeat(asks[lo:hi], each[lo:hi])
                nth = np.arange(len(left)) - np.repeat(np.cumsum(each[lo:hi]) - each[lo:hi], each[lo:hi])
                right = own[first[cell[left]] + nth] if len(left) else left
                differing = sum(np.bitwise_count((s[left] ^ s[right]).view(np.uint64)).astype(np.int16) for s in (s0, s1))
                near = (differing <= most) & (node[left] != node[right])
                if near.any():
                    a, b = node[left[near]], node[right[near]]
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield pa.record_batch({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})
            held = rows[:, (cell == cell[-1]) & (probe == 0)]

    dealt = rows.repartition(F.col("key").bitwiseAND(F.lit(-2).cast("long"))).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def steps(each: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of probes with about STEP candidates together."""
    ends = np.cumsum(each)
    lo = 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        yield lo, hi
        lo = hi


def verified(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine is really reached, in double precision."""
    a = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"))
    b = nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch[c].offsets.to_numpy() for c in ("va", "vb")]
            flat = [batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("va", "vb")]
            size, other = np.diff(ends[0]), np.diff(ends[1])
            ok = np.zeros(len(size), bool)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero((size == dim) & (other == dim))
                x, y = (f[e[at][:, None] - e[0] + np.arange(dim)] for f, e in zip(flat, ends, strict=True))
                x, y = (u / np.abs(u).max(axis=1, keepdims=True) for u in (x, y))  # no overflow, no underflow
                dot = [np.einsum("ij,ij->i", u, w) for u, w in ((x, y), (x, x), (y, y))]
                ok[at] = dot[0] / np.sqrt(dot[1] * dot[2]) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def embedding_groups(
    vectors: DataFrame,
    cosine: float = 0.9,
    tables: int | None = None,
    probes: int = PROBES,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Links have a cosine of ``cosine`` or more, found with probability ``RECALL`` at least (the number of ``tables`` follows from
    the cosine where it isn't given; low cosines take many); equal vectors all link with each
    other. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing (component: their own id). Vectors of different lengths never link. Repeated
    rows count each; a null id gets the smallest id of its component. An empty
    table gives an empty result; other columns (labels too) are ignored. Vectors may be of any length; one is a row.
    """
    tables = tables_for(cosine, probes, scale) if tables is None else tables
    given = F.col(vector_col)
    component = given.cast("array<double>")
    ok = F.coalesce(
        F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(component, lambda x: x != 0), F.lit(False)
    )
    # floats stay floats while they travel; + 0.0 makes the two zeros one
    narrow = vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>"
    digits = F.concat_ws(",", F.transform(component, lambda x: x + F.lit(0.0)).cast("array<string>"))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(ok, given if narrow else component).alias("v"),
        F.when(ok, F.unhex(F.sha2(digits, 256))).alias("same"),
    )
    valid = rows.where("v IS NOT NULL")
    nodes = written(
        valid.groupBy("same").agg(F.first("v").alias("v"), F.min("id").alias("first"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()),
        "e8nodes",
    )
    most_cells = tables * nodes.count() // cell_rows
    cells = split_cells(lattice_rows(nodes, tables, probes, scale), lattice_rows(nodes, tables, 0, scale), most_cells, cell_rows)
    links = verified(meeting_pairs(cells, cosine), nodes, cosine).checkpoint()
    sizes = nodes.select("node", "size")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    degree = both.join(sizes.toDF("other", "n"), "other").groupBy("node").agg(F.sum("n").alias("others"))
    named = nodes.select("node", "same", "first", "size").join(connected_components(links), "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    facts = (
        named.join(smallest, "c")
        .join(degree, "node", "left")
        .select("same", "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))
    )
    joined = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = joined.union(valid.select("id", "same").join(facts, "same").select("id", "n_links", "component_id"))
    return joined.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
