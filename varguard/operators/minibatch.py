"""Constrained descent in mini-batches, without a job for each batch.

Every epoch cuts the labelled rows and the groups into batches (SP3's seeded permutations: 12 rows, 5 groups)
and deals the batches to shards. A shard walks its batches one after the other in one task: Adam on
the Lagrangian of the batch, ascent on lambda. At the end of the epoch the shards' parameters and moments are
averaged, weighted by their steps (local SGD), and the next epoch begins with the mean: one job per epoch.
With one shard this is the sequential descent.

Members of a group with the same known words are one row with a count, so a group of any size is as
large as its variety of known words. A batch of groups is sent once an epoch, however many steps take it again: the
task keeps its batches of groups in a temporary file and holds the rows of one step at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GROUP_BATCH_SIZE, PRIMARY_BATCH_SIZE, SEED, STABILITY_CONST, VPROB, Constraint
from ..functions.stats import t_ppf
from ..session import scratch_path
from .prep import assign_batches
from .score import parameter_frame, score_terms
from .train import DescentConfig


@dataclass(frozen=True)
class MiniBatchConfig(DescentConfig):
    primary_batch: int = PRIMARY_BATCH_SIZE
    group_batch: int = GROUP_BATCH_SIZE
    seed: int = SEED


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _hits(df: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    return score_terms(df.select(*keys, "text"), model, keep_hits=True).select(*keys, F.array_sort("hits").alias("hits"))


def batch_rows(primary: DataFrame, groups: DataFrame, model: DataFrame, cfg: MiniBatchConfig, shards: int, key: str, group_col: str) -> tuple[DataFrame, int]:
    """``(epoch, shard, step, kind, unit, label, n, hits)``, written once, and the number of shards: at most one for each batch of
    labelled rows and of groups. In its shard, step i has the i-th batch of rows (kind 0) and the batch of groups (kind 1)
    of number i modulo those that the shard has; a batch of groups stands once, under its own number."""
    rows = _written(_hits(primary.where(F.col("label").isNotNull()), model, [key, "label"]), "minibatch-rows")
    folded = _hits(groups, model, [group_col]).groupBy(group_col, "hits").agg(F.count(F.lit(1)).alias("n"))
    folded = _written(folded, "minibatch-groups")
    units = folded.groupBy(group_col).agg(F.sum("n").alias("members")).where("members >= 2").select(group_col)  # no variance of one
    n_rows, n_groups = rows.count(), units.count()
    batches, group_batches = -(-n_rows // cfg.primary_batch), -(-n_groups // cfg.group_batch)
    shards = max(1, min(shards, batches, group_batches or batches))

    def dealt(df: DataFrame, by: str, size: int) -> DataFrame:
        cut = assign_batches(df, by, size, cfg.n_epochs, cfg.seed)
        return cut.withColumns({"shard": (F.col("batch_id") % shards).cast("int"), "turn": F.floor(F.col("batch_id") / F.lit(shards))})

    p = dealt(rows, key, cfg.primary_batch)
    p = p.select("epoch", "shard", F.col("turn").alias("step"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("unit"), F.col("label").cast("double"), F.lit(1.0).alias("n"), "hits")
    if not n_groups:
        return _written(p, "minibatch"), shards
    steps = F.floor((F.lit(batches - 1) - F.col("shard")) / F.lit(shards)) + 1  # batches of numbers shard, shard + shards, ...
    g = dealt(units, group_col, cfg.group_batch).where(F.col("turn") < steps)
    g = g.join(folded, group_col).select(
        "epoch", "shard", F.col("turn").alias("step"), F.lit(1).alias("kind"), F.xxhash64(group_col).alias("unit"), F.lit(None).cast("double").alias("label"), F.col("n").cast("double").alias("n"), "hits"
    )
    return _written(p.unionByName(g), "minibatch"), shards


def parameters_of(hits: pa.Array, terms: pa.Array) -> pa.Array:
    """Numbers of each row's parameters: the bias (0) and its words."""
    size = pc.list_value_length(hits).to_numpy() + 1
    end = np.concatenate([[0], np.cumsum(size)])
    word = np.ones(end[-1], bool)
    word[end[:-1]] = False
    at = np.zeros(len(word), np.int32)
    at[word] = pc.index_in(hits.flatten(), value_set=terms).to_numpy() + 1
    return pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(at))


class GroupBatches:
    """A shard's batches of groups in a temporary file; the one last read stays at hand."""

    def __init__(self):
        self.file, self.sink, self.source, self.count, self.held = tempfile.TemporaryFile(), None, None, 0, (None, None)

    def add(self, rows: pa.RecordBatch) -> None:
        self.sink = self.sink or pa.ipc.new_file(self.file, rows.schema)
        self.sink.write_batch(rows)
        self.count += 1

    def at_step(self, step: int) -> pa.RecordBatch | None:
        if not self.count:
            return None
        if self.source is None:
            self.sink.close()
            self.source = pa.ipc.open_file(self.file)
        if (i := step % self.count) != self.held[0]:
            self.held = i, self.source.get_batch(i)
        return self.held[1]

    def close(self) -> None:
        self.file.close()


class Walker:
    """Parameters of a shard and their way through its batches; index 0 is the bias."""

    def __init__(self, theta, m, v, lam: float, t: int, cfg: MiniBatchConfig, constraint: Constraint, k: float | None):
        self.theta, self.m, self.v = (np.array(x, float) for x in (theta, m, v))
        self.lam, self.t, self.cfg, self.constraint, self.k = lam, t, cfg, constraint, k
        self.steps, self.loss, self.g, self.n_g = 0, 0.0, 0.0, 0

    def _scores(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and parameter of every known word (and bias), and the rows' probabilities."""
        row, at = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["at"]).to_numpy()), rows["at"].flatten().to_numpy()
        with np.errstate(over="ignore"):
            return row, at, 1 / (1 + np.exp(-np.bincount(row, self.theta[at], len(rows))))

    def loss_gradient(self, rows: pa.RecordBatch) -> tuple[float, np.ndarray]:
        row, at, p = self._scores(rows)
        y, c = rows["label"].to_numpy(), STABILITY_CONST
        loss = -y * np.log(p + c) - (1 - y) * np.log(1 - p + c)
        r = (-y / (p + c) + (1 - y) / (1 - p + c)) * p * (1 - p)
        return float(loss.mean()), np.bincount(at, r[row], len(self.theta)) / len(rows)

    def target_gradient(self, rows: pa.RecordBatch) -> tuple[float, np.ndarray]:
        """The constraint's value over a batch of groups (mean variance, or with k the predicted bound) and its gradient."""
        row, at, p = self._scores(rows)
        _, group = np.unique(rows["unit"].to_numpy(), return_inverse=True)
        n = rows["n"].to_numpy()
        size = np.bincount(group, n)
        away = p - (np.bincount(group, n * p) / size)[group]
        var = np.bincount(group, n * away * away) / (size - 1)
        slope = 2 * n * away * p * (1 - p) / (size - 1)[group]  # of a group's variance by a member's logit
        count, sign = len(size), self.constraint.sign
        share = np.full(count, sign / count)
        value, sd = sign * var.mean(), var.std(ddof=1) if count > 1 else 0.0
        if self.k is not None and sd > 0:
            share += self.k * (var - var.mean()) / (sd * (count - 1))
            value += self.k * sd
        return float(value - sign * self.constraint.threshold), np.bincount(at, (slope * share[group])[row], len(self.theta))

    def step(self, rows: pa.RecordBatch, members: pa.RecordBatch | None) -> None:
        cfg = self.cfg
        loss, grad = self.loss_gradient(rows)
        g, bent = self.target_gradient(members) if members is not None else (None, 0.0)
        grad = grad + self.lam * bent
        self.t += 1
        self.m = cfg.beta_velocity * self.m + (1 - cfg.beta_velocity) * grad
        self.v = cfg.beta_rmsprop * self.v + (1 - cfg.beta_rmsprop) * grad * grad
        way = self.m / (1 - cfg.beta_velocity**self.t) / (np.sqrt(self.v / (1 - cfg.beta_rmsprop**self.t)) + cfg.eps)
        self.theta -= cfg.alpha_theta * way
        self.steps, self.loss = self.steps + 1, self.loss + loss
        if g is not None:
            self.lam = max(0.0, self.lam + cfg.alpha_lambda * g)
            self.g, self.n_g = self.g + g, self.n_g + 1


WALK_SCHEMA = "shard int, steps long, loss double, g double, n_g long, lam double, at int, theta double, m double, v double"


def walk(rows: DataFrame, shards: int, start: tuple, names: list, cfg: MiniBatchConfig, constraint: Constraint, k: float | None) -> DataFrame:
    """Each shard's way through an epoch's rows: ``(shard, steps, loss, g, n_g, lam, at, theta, m, v)``, a row for each parameter
    (``loss`` and ``g`` summed over its steps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, key, held, groups, walker = pa.array(names[1:], pa.string()), None, [], None, None

        def out() -> pa.RecordBatch:
            n = len(walker.theta)
            head = {c: [x] * n for c, x in (("shard", key[0]), ("steps", walker.steps), ("loss", walker.loss), ("g", walker.g), ("n_g", walker.n_g), ("lam", walker.lam))}
            kinds = {"shard": pa.int32(), "steps": pa.int64(), "n_g": pa.int64()}
            cols = {c: pa.array(x, kinds.get(c, pa.float64())) for c, x in head.items()}
            return pa.record_batch(cols | {"at": pa.array(range(n), pa.int32()), "theta": pa.array(walker.theta), "m": pa.array(walker.m), "v": pa.array(walker.v)})

        def done() -> None:
            """The rows held are a batch of groups or a step's batch of rows."""
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if key[1]:
                groups.add(whole)
            else:
                walker.step(whole, groups.at_step(key[2]))

        for batch in batches:
            cols = {c: batch[c] for c in ("unit", "label", "n")} | {"at": parameters_of(batch["hits"], terms)}
            ready, keys = pa.record_batch(cols), np.stack([batch[c].to_numpy() for c in ("shard", "kind", "step")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if (new := tuple(keys[lo].tolist())) != key:
                        if held:
                            done()
                        if key is None or new[0] != key[0]:
                            if walker:
                                yield out()
                                groups.close()
                            walker, groups = Walker(*start, cfg, constraint, k), GroupBatches()
                        key, held = new, []
                    held.append(ready.slice(lo, hi - lo))
        if held:
            done()
            yield out()
            groups.close()

    order = ["shard", F.col("kind").desc(), "step", "unit", "label", "hits"]  # a shard's groups before its rows
    return rows.repartitionById(shards, "shard").sortWithinPartitions(*order).mapInArrow(run, WALK_SCHEMA)


def fit_minibatch(
    primary: DataFrame,
    groups: DataFrame,
    init_weights: dict,
    init_bias: float,
    cfg: MiniBatchConfig = MiniBatchConfig(),
    constraint: Constraint = VPROB,
    n_safety: int | None = None,
    shards: int = 8,
    key: str = "doc_id",
    group_col: str = "group_id",
) -> tuple[dict, float, list]:
    """Constrained descent over ``cfg.n_epochs`` epochs of mini-batches: ``(theta, bias, log)``.

    A log row is ``(epoch, steps, loss, g, lam, theta)``: the epoch's steps in all shards, the mean loss and g of their batches
    (each before its update), lambda and the parameters after the epoch. ``n_safety`` makes g the predicted bound of a
    batch, as in :func:`~varguard.operators.train.fit_constrained`. Rows without a label and groups of one member take no
    part; without groups only the loss falls; without rows nothing happens and the log is empty. More shards are faster
    and average more; the driver gets one row per parameter and epoch.
    """
    spark = primary.sparkSession
    names = [None, *sorted(init_weights)]
    theta = [float(init_bias), *(float(init_weights[w]) for w in names[1:])]
    m, v, lam, t, log = [0.0] * len(names), [0.0] * len(names), float(cfg.lambda_init), 0, []
    k = 2.0 * t_ppf(1.0 - constraint.delta, n_safety - 1) / float(n_safety) ** 0.5 if n_safety is not None and n_safety >= 2 else None
    model = parameter_frame(spark, [(0, w, x) for w, x in zip(names, theta, strict=True)])
    rows, shards = batch_rows(primary, groups, model, cfg, shards, key, group_col)
    for epoch in range(cfg.n_epochs):
        walked = walk(rows.where(F.col("epoch") == epoch).drop("epoch"), shards, (theta, m, v, lam, t), names, cfg, constraint, k)
        n = F.sum("steps")
        mean = lambda c: (F.sum(F.col(c) * F.col("steps")) / n).alias(c)
        got = walked.groupBy("at").agg(
            n.alias("steps"), F.max("steps").alias("longest"), F.sum("loss").alias("loss"), F.sum("g").alias("g"), F.sum("n_g").alias("n_g"), mean("lam"), mean("theta"), mean("m"), mean("v")
        )
        got = sorted(got.collect(), key=lambda r: r["at"])  # one row per parameter
        if not got:
            break
        theta, m, v = ([r[c] for r in got] for c in ("theta", "m", "v"))
        first = got[0]
        lam, t = first["lam"], t + first["longest"]
        log.append((epoch, first["steps"], first["loss"] / first["steps"], first["g"] / first["n_g"] if first["n_g"] else None, lam, list(zip(names, theta, strict=True))))
    return dict(zip(names[1:], theta[1:], strict=True)), theta[0], log


LOG_SCHEMA = "epoch int, steps long, loss double, g double, lam double, theta array<struct<term:string,weight:double>>"
