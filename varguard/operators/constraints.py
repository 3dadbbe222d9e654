"""Constraints as data, high-confidence bounds and the safety test.

A constraint ``measure op threshold`` with confidence ``1 - delta`` turns a
measure into ``g`` (safe iff g <= 0). The Student-t upper bound of g over a
set of n units is

    sign * mean + sd / sqrt(n) * t(1 - delta, n - 1) - sign * threshold

and the candidate-side prediction of the safety bound doubles the width and
uses the size of the safety set instead of n. All of it is Column arithmetic
on one summary row per (model, constraint).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Constraint
from ..functions.scalar import sigmoid
from ..functions.stats import t_quantile

# Registered group measures: name -> aggregate over the member probability.
_MEASURES: dict[str, Callable[[Column], Column]] = {}


def register_measure(name: str, agg: Callable[[Column], Column]) -> None:
    """Bind a grouped aggregate to a measure name usable in constraints.

    ``agg`` maps the member-probability Column to a Spark aggregate Column,
    so every measure of a group is computed in one ``groupBy(unit).agg`` pass
    and combined map-side (a huge group never sits in one task).
    """
    _MEASURES[name] = agg
    _MERGEABLE.pop(name, None)


@dataclass(frozen=True)
class Mergeable:
    """A user's group measure in Python: a state of a few doubles, and functions on it.

    ``init()`` gives the state of no members, ``update(state, p)`` takes in an array of member probabilities,
    ``merge(a, b)`` joins the states of two parts of a group, ``finish(state)`` is the measure's value
    (None: undefined). A state is a sequence of floats."""

    init: Callable[[], Sequence[float]]
    update: Callable[[Sequence[float], np.ndarray], Sequence[float]]
    merge: Callable[[Sequence[float], Sequence[float]], Sequence[float]]
    finish: Callable[[Sequence[float]], float | None]


_MERGEABLE: dict[str, Mergeable] = {}
#: Groups whose states a task holds before it sends them on.
HELD_GROUPS = 1 << 16


def register_mergeable(name: str, init, update, merge, finish) -> None:
    """Bind a Python function to a measure name usable in constraints. Every task makes one state for each
    of its groups, and states are merged per group, so a group of any size never sits in one task."""
    _MERGEABLE[name] = Mergeable(init, update, merge, finish)
    _MEASURES.pop(name, None)


def is_mergeable(name: str) -> bool:
    return name in _MERGEABLE


def measure(name: str) -> Callable[[Column], Column]:
    """The Spark aggregate of a measure; one in Python (``register_mergeable``) has none."""
    if name not in _MEASURES:
        raise KeyError(f"unknown measure {name!r}; registered: {sorted([*_MEASURES, *_MERGEABLE])}")
    return _MEASURES[name]


def check_measure(name: str) -> None:
    if name not in _MERGEABLE:
        measure(name)


def partial_states(members: DataFrame, keys: list[str], m: Mergeable, held_groups: int = HELD_GROUPS) -> DataFrame:
    """``(keys..., n_members, state)``: a state for each group and task (several where a task meets more than
    ``held_groups`` groups). ``members`` has the keys and ``p``; NULL probabilities count as members only."""
    fields = [f for f in members.schema.fields if f.name in keys]
    order = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, n, list(map(float, state))) for key, (n, state) in held.items()]
            held.clear()
            cols = list(zip(*rows, strict=True))
            types = [*key_types, pa.int64(), pa.list_(pa.float64())]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*order, "n_members", "state"])

        key_types: list = []
        for batch in batches:
            key_types = key_types or [batch.schema.field(c).type for c in order]
            table = pa.Table.from_batches([batch]).group_by(order, use_threads=False).aggregate([("p", "list")])
            lists = table["p_list"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            for key, values in zip(zip(*[table[c].to_pylist() for c in order], strict=True), lists, strict=True):
                p = values.values
                n, state = held.get(key) or (0, m.init())
                held[key] = [n + len(p), m.update(state, p.drop_null().to_numpy(zero_copy_only=False))]
            if len(held) >= held_groups:
                yield out()
        if held:
            yield out()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_members long, state array<double>"
    return members.select(*order, "p").mapInArrow(run, ddl)


def merged_measure(members: DataFrame, keys: list[str], m: Mergeable) -> DataFrame:
    """``(keys..., n_members, value)``: the tasks' states of a group come sorted into one task and are merged one
    after the other, so it holds a single state at a time."""
    states = partial_states(members, keys, m)
    order = states.columns[:-2]
    ddl = ", ".join(f"`{c}` {t}" for c, t in states.dtypes[:-2]) + ", n_members long, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, state, key_types = None, 0, None, []

        def made(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * (len(order) + 2)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [*key_types, pa.int64(), pa.float64()], strict=True)], names=[*order, "n_members", "value"])

        def row() -> tuple:
            value = m.finish(state)
            return (*last, n, None if value is None else float(value))

        for batch in batches:
            key_types = key_types or [batch.schema.field(c).type for c in order]
            rows = []
            for *key, count, part in zip(*[batch[c].to_pylist() for c in (*order, "n_members", "state")], strict=True):
                if state is not None and key == last:
                    n, state = n + count, m.merge(state, part)
                else:
                    if state is not None:
                        rows.append(row())
                    last, n, state = key, count, part
            if rows:
                yield made(rows)
        if state is not None:
            yield made([row()])

    return states.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, ddl)


def group_measures(
    members: DataFrame,
    names: Sequence[str],
    group_col: str = "group_id",
    logit_col: str = "logit",
    by=("candidate_id",),
) -> DataFrame:
    """Long form ``(by..., group_id, n_members, measure, value)``: every named
    measure of every group, from one aggregation."""
    names = list(dict.fromkeys(names))
    p = sigmoid(F.col(logit_col))
    theirs = [n for n in names if is_mergeable(n)]
    if theirs:
        probabilities = members.select(*by, group_col, p.alias("p"))
        cols = [*by, group_col, "n_members"]
        found = [
            merged_measure(probabilities, [*by, group_col], _MERGEABLE[n]).select(*cols, F.lit(n).alias("measure"), "value") for n in theirs
        ]
        own = [n for n in names if n not in theirs]
        found += [group_measures(members, own, group_col, logit_col, by)] if own else []
        return reduce(DataFrame.unionByName, found)
    aggs = [measure(n)(p).alias(f"_m{i}") for i, n in enumerate(names)]
    per_group = members.groupBy(*by, group_col).agg(F.count(F.lit(1)).alias("n_members"), *aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"_m{i}").cast("double").alias("value")) for i, n in enumerate(names)])
    return per_group.select(*by, group_col, "n_members", F.explode_outer(pairs).alias("_x")).select(
        *by, group_col, "n_members", "_x.measure", "_x.value"
    )


def constraint_bounds(
    summary: DataFrame, constraints: Sequence[Constraint], by=("candidate_id",), candidates: DataFrame | None = None
) -> DataFrame:
    """Per (model, constraint): ``n, mean, sd, g`` (point) and ``upper_bound``.

    ``summary`` is long form ``(by..., measure, n, n_dropped, mean, sd)``.
    Every constraint of every model has a row: one whose measure has no
    summary has n = 0 and no bound, so it can't pass. ``candidates`` lists the
    models; without it they are those of the summary."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c.name).alias("name"), F.lit(c.measure).alias("measure")) for i, c in enumerate(constraints)])
    models = (summary if candidates is None else candidates).select(*by).distinct()
    asked = models.select(*by, F.explode(every).alias("_c")).select(*by, F.col("_c.i").alias("_i"), F.col("_c.name").alias("constraint_name"), F.col("_c.measure").alias("measure"))
    found = asked.join(summary.select(*by, "measure", "n", "mean", "sd"), [*by, "measure"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))

    def own(expr):
        return F.coalesce(*[F.when(F.col("_i") == i, expr(c)) for i, c in enumerate(constraints)])

    return found.select(
        *by,
        "constraint_name",
        "n",
        "mean",
        "sd",
        own(lambda c: g_value(F.col("mean"), c)).alias("g"),
        own(lambda c: t_upper_bound(F.col("n"), F.col("mean"), F.col("sd"), c)).alias("upper_bound"),
    )


def g_value(value: Column, c: Constraint) -> Column:
    """Point value of g for a measure value."""
    return F.lit(c.sign) * value - F.lit(c.sign * c.threshold)


def t_upper_bound(n: Column, mean: Column, sd: Column, c: Constraint) -> Column:
    """High-confidence upper bound of g from a summary (NULL when n < 2)."""
    nd = n.cast("double")
    return F.when(
        n >= 2,
        F.lit(c.sign) * mean + sd / F.sqrt(nd) * t_quantile(n - 1, 1.0 - c.delta) - F.lit(c.sign * c.threshold),
    )


def predicted_bound(mean: Column, sd: Column, n_safety: Column, c: Constraint) -> Column:
    """Candidate-side prediction of the safety bound (width doubled, n = safety size)."""
    ns = n_safety.cast("double")
    return F.when(
        n_safety >= 2,
        F.lit(c.sign) * mean
        + F.lit(2.0) * sd / F.sqrt(ns) * t_quantile(n_safety - 1, 1.0 - c.delta)
        - F.lit(c.sign * c.threshold),
    )


def passes(bound: Column, n_units: Column, min_units: int = 2) -> Column:
    """Safe iff the bound exists, is <= 0 and enough distinct units were seen."""
    return F.coalesce(bound <= 0, F.lit(False)) & (F.coalesce(n_units, F.lit(0)) >= min_units)


def safety_test(bounds: DataFrame, by=("candidate_id",), bound_col: str = "upper_bound", n_col: str = "n", min_units: int = 2) -> DataFrame:
    """Pass iff every constraint row of a model passes: ``(by..., n_constraints, passed)``."""
    return bounds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_constraints"),
        F.bool_and(passes(F.col(bound_col), F.col(n_col), min_units)).alias("passed"),
    )


register_measure("VPROB", lambda p: F.var_samp(p))
register_measure("VRANGE", lambda p: F.when(F.count(p) >= 2, F.max(p) - F.min(p)))


def _entropic_update(state, p):
    """State: members, their sum, the largest t p, and the sum of exp(t p) scaled by it (so nothing overflows)."""
    return state if not len(p) else _entropic_merge(state, (len(p), p.sum(), ENTROPIC_T * p.max(), np.exp(ENTROPIC_T * (p - p.max())).sum()))


def _entropic_merge(a, b):
    top = max(a[2], b[2])
    return a[0] + b[0], a[1] + b[1], top, sum(x[3] * np.exp(x[2] - top) for x in (a, b) if x[0])


#: How strongly the largest probabilities of a group count in VENTROPIC.
ENTROPIC_T = 10.0
# a measure in Python: log-mean-exp of a group's probabilities less their mean, 0 where all are equal
register_mergeable(
    "VENTROPIC",
    lambda: (0.0, 0.0, -np.inf, 0.0),
    _entropic_update,
    _entropic_merge,
    lambda s: (s[2] + np.log(s[3] / s[0])) / ENTROPIC_T - s[1] / s[0] if s[0] >= 2 else None,
)


@dataclass(frozen=True)
class Binding:
    """A constraint with the group table it is measured on, the batch size in
    groups of that table, and the table's name."""

    constraint: Constraint
    dataset: str
    members: DataFrame
    batch: int


def bind(constraint: Constraint, dataset: str, members: DataFrame, batch: int) -> Binding:
    """Bind a constraint to scored members ``(candidate_id, group_id, logit)``."""
    check_measure(constraint.measure)  # an unknown one fails here
    if batch < 1:
        raise ValueError("a batch holds one group at least")
    return Binding(constraint, dataset, members, batch)


def evaluate_bindings(bindings: Sequence[Binding]) -> DataFrame:
    """``(candidate_id, quantity, dataset, n_units, n_batches, value)``: each
    constraint's measure averaged over the groups of its own table."""
    if not bindings:
        raise ValueError("no bindings")
    tables: dict[int, list[Binding]] = {}
    for b in bindings:
        tables.setdefault(id(b.members), []).append(b)
    out = None
    for same in tables.values():  # bindings of one table share its scan and aggregation
        long = group_measures(same[0].members, [b.constraint.measure for b in same])
        of = lambda b: F.when(F.col("measure") == b.constraint.measure, F.col("value"))
        per_model = long.groupBy("candidate_id").agg(
            *[F.count(of(b)).alias(f"_n{i}") for i, b in enumerate(same)],
            *[F.avg(of(b)).alias(f"_v{i}") for i, b in enumerate(same)],
            F.count(F.when(F.col("measure") == same[0].constraint.measure, F.lit(1))).alias("_groups"),
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(b.constraint.name).alias("quantity"),
                    F.lit(b.dataset).alias("dataset"),
                    F.col(f"_n{i}").alias("n_units"),
                    F.ceil(F.col("_groups") / F.lit(b.batch)).alias("n_batches"),
                    F.col(f"_v{i}").alias("value"),
                )
                for i, b in enumerate(same)
            ]
        )
        found = per_model.select("candidate_id", F.explode(rows).alias("_b")).select("candidate_id", "_b.*")
        out = found if out is None else out.unionByName(found)
    return out
