"""Nearest neighbours by a block matrix join.

Vectors are kept as int8 copies with a rigorous error bound and packed into blocks. Every query
block meets every block of candidates (an equi-join on the strip of blocks): an integer matrix
product gives all inner products of the tile within the bounds of quantisation. A first pass over the tiles
finds each query's k-th largest lower bound, a second one the pairs whose upper bound reaches it. Those
are computed again in double precision on the vectors themselves and merged by heaps.

Equal vectors are one node that keeps its smallest ids: of equal rows only those can be among
the nearest, so a vector that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a block; blocks of candidates to a strip; columns of a tile computed at a time.
BLOCK, STRIP, TILE = 4096, 16, 512
#: Rounding of the doubles that bounds are computed in, relative to the product of norms.
ROUNDING = 1e-9
#: The largest dimension whose integer products are exact in float32.
EXACT32 = (1 << 24) // (127 * 127)


def small_copy(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 copies of the rows of ``v``, their scales, their norms and the distances to the rows."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale < 1e-300] = 1.0  # the copy is zero then, the error bound covers it
    q = np.rint(v / scale[:, None])
    error = np.linalg.norm(v - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, np.linalg.norm(v, axis=1), error


def packed(nodes: DataFrame, block: int) -> DataFrame:
    """``(dim, ids, copies, facts)``: up to ``block`` vectors ``(node, v)`` of one length in a row."""

    def pack(ids: list, rows: list) -> dict:
        q, *facts = small_copy(np.array(rows, np.float64))
        return {"dim": q.shape[1], "ids": np.array(ids, np.int64).tobytes(), "copies": q.tobytes(), "facts": np.stack(facts).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        shape = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("facts", pa.binary())])
        for batch in batches:
            for node, v in zip(batch["node"].to_pylist(), batch["v"], strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(node)
                rows.append(v.values.to_numpy())
                if len(ids) == block:
                    yield pa.RecordBatch.from_pylist([pack(*held.pop(len(v)))], shape)
        yield pa.RecordBatch.from_pylist([pack(*x) for x in held.values()], shape)

    return nodes.select("node", "v").mapInArrow(run, "dim int, ids binary, copies binary, facts binary")


class Block:
    """A packed row, unpacked."""

    def __init__(self, dim: int, ids: bytes, copies: bytes, facts: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.copies = np.frombuffer(copies, np.int8).reshape(-1, dim).astype(np.float32 if dim <= EXACT32 else np.float64)
        self.scale, self.norm, self.error = np.frombuffer(facts, np.float64).reshape(3, -1)


def tile_bounds(x: Block, y: Block, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of ``x`` with a part of ``y``.

    With copies x', y': |xy - x'y'| <= |x - x'| |y'| + |x| |y - y'|, and |y'| <= |y| + |y - y'|."""
    about = (x.copies @ y.copies[part].T).astype(np.float64) * x.scale[:, None] * y.scale[part]
    reach = x.error[:, None] * (y.norm[part] + y.error[part]) + x.norm[:, None] * (y.error[part] + ROUNDING * y.norm[part])
    low, high = about - reach, about + reach
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # products beyond a double's range
    return low, high


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(row, x, new, y)`` of each tile: the query block and a block of candidates; ``new``: another query block than before."""
    key, x = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if new := (row["strip"], row["nth"]) != key:
                key, x = (row["strip"], row["nth"]), Block(row["dim"], row["ids"], row["copies"], row["facts"])
            yield row, x, new, Block(row["dim"], row["c_ids"], row["c_copies"], row["c_facts"])


def largest(values: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` largest of each row, in any order."""
    return np.partition(values, values.shape[1] - keep, axis=1)[:, -keep:] if values.shape[1] > keep else values


def least_scores(tiles: DataFrame, keep: int) -> DataFrame:
    """``(nth, least)``: for each query of a block the ``keep``-th largest lower bound over all candidates; no pair
    whose upper bound is below it can be among the ``keep`` nearest. Each strip sends its largest bounds only."""

    def of_strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, best = None, None
        for row, x, new, y in meetings(batches):
            if new:
                if best is not None:
                    yield pa.record_batch({"nth": pa.array([nth], pa.int64()), "best": pa.array([best.tobytes()], pa.binary())})
                nth, best = row["nth"], np.full((len(x.ids), keep), -np.inf)
            for at in range(0, len(y.ids), TILE):
                best = largest(np.concatenate([best, tile_bounds(x, y, slice(at, at + TILE))[0]], axis=1), keep)
        if best is not None:
            yield pa.record_batch({"nth": pa.array([nth], pa.int64()), "best": pa.array([best.tobytes()], pa.binary())})

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, best = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch({"nth": pa.array([nth], pa.int64()), "least": pa.array([best.min(axis=1).tobytes()], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                found = np.frombuffer(row["best"], np.float64).reshape(-1, keep)
                if row["nth"] == nth:
                    best = largest(np.concatenate([best, found], axis=1), keep)
                else:
                    if best is not None:
                        yield out()
                    nth, best = row["nth"], found
        if best is not None:
            yield out()

    bests = tiles.mapInArrow(of_strip, "nth long, best binary")
    return bests.repartition("nth").sortWithinPartitions("nth").mapInArrow(of_all, "nth long, least binary")


def surviving_pairs(tiles: DataFrame) -> DataFrame:
    """``(a, b)``: pairs whose upper bound reaches their query's ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, _, y in meetings(batches):
            least = np.frombuffer(row["least"], np.float64)[:, None]
            for at in range(0, len(y.ids), TILE):
                part = slice(at, at + TILE)
                a, b = np.nonzero(tile_bounds(x, y, part)[1] >= least)
                yield pa.record_batch({"a": pa.array(x.ids[a]), "b": pa.array(y.ids[part][b])})

    return tiles.mapInArrow(run, "a long, b long")


def by_query(rows: DataFrame, pick, schema: str, *order: str) -> DataFrame:
    """``pick`` of the rows of each query ``a``, whose rows follow one another in one task."""
    names = [c for c in rows.columns if c != "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for a, *row in zip(*(batch[c].to_pylist() for c in ("a", *names)), strict=True):
                if a != key:
                    out += [(key, *r) for r in pick(held)]
                    key, held = a, []
                held.append(row)
            yield made(out)
        yield made([(key, *r) for r in pick(held)])

    shape = pa.schema([(name, {"long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in map(str.split, schema.split(", "))])

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)

    return rows.repartition("a").sortWithinPartitions("a", *order).mapInArrow(run, schema)


def inner_products(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, score, ids)``: inner products in double precision, components summed in order."""
    x = nodes.select(F.col("node").alias("a"), F.col("v").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("v").alias("y"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["x"].offsets.to_numpy())
            u, w = (batch[c].flatten().to_numpy() for c in ("x", "y"))
            starts, score = np.cumsum(sizes) - sizes, np.zeros(len(sizes))
            for i in range(int(sizes.max(initial=0))):
                has = sizes > i
                score[has] += u[starts[has] + i] * w[starts[has] + i]
            yield pa.record_batch({"a": batch["a"], "b": batch["b"], "score": pa.array(score), "ids": batch["ids"]})

    joined = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y", "ids")
    return joined.mapInArrow(run, "a long, b long, score double, ids array<long>")


def nearest_neighbours(
    vectors: DataFrame,
    queries,
    k: int = 20,
    block: int = BLOCK,
    strip: int = STRIP,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each row for which the condition
    ``queries`` holds with all other rows, ties to the smaller id (null ids last).

    Exact: the bounds only spare products that can't be among the nearest. Vectors that are null, empty, zero
    or hold null or non-finite components take no part; vectors of different lengths aren't compared. A query
    isn't its own neighbour, but rows that repeat its id or its vector are. Rows with a null id are
    candidates only. With fewer candidates than ``k`` all are returned; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    component = F.col(vector_col).cast("array<double>")
    ok = F.coalesce(
        F.forall(component, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(component, lambda c: c != 0), F.lit(False)
    )
    rows = vectors.where(ok).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(queries & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"), F.transform(component, lambda c: c + 0.0).alias("v")
    )
    # of equal vectors the k + 1 smallest ids are enough: one of them may be the query's own
    first = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    smallest = rows.select("v", "id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    asked = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    nodes = smallest.groupBy("v").agg(F.array_sort(F.collect_list(F.struct(F.col("nth"), F.col("id")))).alias("ids"))
    nodes = nodes.join(asked, "v").select("v", "asks", F.transform("ids", lambda s: s["id"]).alias("ids"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    blocks = written(packed(nodes, block).withColumn("nth", F.monotonically_increasing_id()), "blocks")
    asking = written(packed(nodes.where("asks"), block).withColumn("nth", F.monotonically_increasing_id()), "queries")
    n = max(1, blocks.count())
    strips = min(n, max(-(-n // strip), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = blocks.select(
        F.pmod(F.xxhash64("nth"), F.lit(strips)).cast("int").alias("strip"), "dim", *[F.col(c).alias(f"c_{c}") for c in ("ids", "copies", "facts")]
    )

    def tiles(asking: DataFrame) -> DataFrame:
        """Merged: a query block meets the blocks of its strip one after the other."""
        sent = asking.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
        return sent.join(met.hint("merge"), ["strip", "dim"])

    least = written(least_scores(tiles(asking), k + 1), "least")
    survivors = surviving_pairs(tiles(asking.join(least, "nth")))

    def merge(found: list) -> list:
        """The k + 1 nearest rows of a query, each with its vector's node."""
        entries = ((-score, i is None, i or 0, b) for b, score, ids in found for i in ids)
        return [(-s, None if none else i, b) for s, none, i, b in heapq.nsmallest(k + 1, entries)]

    near = by_query(inner_products(survivors, nodes), merge, "a long, score double, vec long, b long")
    lists = near.groupBy("a").agg(F.collect_list(F.struct("score", "vec", "b")).alias("near"))  # k + 1 entries
    of_query = rows.where("asks").select("id", "v").join(nodes.where("asks").select("v", F.col("node").alias("a")), "v").select("id", "a")
    order = lambda s: F.array_sort(
        F.transform(s, lambda e: F.struct((-e["score"]).alias("d"), e["vec"].isNull().alias("none"), e["vec"].alias("vec"), e["b"].alias("b"), e["score"].alias("score")))
    )
    own = F.array_position(F.transform("near", lambda e: F.coalesce((e["vec"] == F.col("id")) & (e["b"] == F.col("a")), F.lit(False))), True)
    others = F.filter("near", lambda e, i: i != own - 1)
    return (
        of_query.join(lists.select("a", order("near").alias("near")), "a")
        .select("id", F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
        .select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec").alias(id_col), F.col("e.score").alias("score"))
    )
