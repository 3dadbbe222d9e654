"""Scoring: text -> logit of the positive class, for one or many models.

The built-in model is linear in term counts: ``logit = b + sum_t w_t * count_t``.
A model set ("candidates") is a small parameter table
``(candidate_id INT, term STRING, weight DOUBLE)``; the row with ``term IS
NULL`` is the bias.

Two physical strategies, chosen by the size of the parameter table:

* inline (``<= INLINE_MAX`` entries): the parameters become a literal map and
  every row is scored in place with ``aggregate`` over its tokens. Narrow, no
  shuffle, no join; the whole text is read.
Generators over computed arrays use the ``_outer`` forms: the arrays are
never empty here, and the plain forms make Catalyst infer a ``size(...) > 0``
filter that re-evaluates the whole scoring expression (pushed even into join
conditions).

* join (larger models): each row's tokens are counted per term and hash-joined
  with the parameters (broadcast when their table is within
  ``BROADCAST_MAX_ROWS``, shuffled otherwise), then summed per (row, candidate);
  the bias is one more entry of the row, so rows without any known term keep it.

``score_with`` runs any Python callable ``list[str] -> list[float]`` over
Arrow batches (``mapInPandas``); the model is built once per Python worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CANDIDATE_WEIGHTS, LEXICON, LEXICON_BIAS
from ..functions.scalar import tokens

INLINE_MAX = 256
#: Scored rows that ``score_with`` sends on together.
SCORED_ROWS = 4096
BROADCAST_MAX_ROWS = 2_000_000

WEIGHT_SCHEMA = T.StructType(
    [
        T.StructField("candidate_id", T.IntegerType(), False),
        T.StructField("term", T.StringType(), True),
        T.StructField("weight", T.DoubleType(), False),
    ]
)


def lexicon_model(
    spark: SparkSession,
    weights=tuple(CANDIDATE_WEIGHTS),
    bias: float = LEXICON_BIAS,
    terms=tuple(LEXICON),
) -> DataFrame:
    """Candidate i: bias ``bias`` and weight ``weights[i]`` for each term."""
    rows = []
    for cid, w in enumerate(weights):
        rows.append((cid, None, float(bias)))
        rows.extend((cid, t, float(w)) for t in terms)
    return parameter_frame(spark, rows)


def parameter_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A parameter table of ``(candidate_id, term, weight)`` tuples; they live on
    the driver already and are kept for the inline scorer."""
    df = spark.createDataFrame(rows, WEIGHT_SCHEMA)
    df._driver_rows = [T.Row(candidate_id=c, term=t, weight=w) for c, t, w in rows]
    return df


def candidate_ids(weights: DataFrame) -> list:
    """Sorted candidate ids of a parameter table: one value per model, which
    every scored row holds a logit for."""
    return sorted(r.candidate_id for r in weights.select("candidate_id").distinct().collect())


def _small_params(weights: DataFrame, limit: int):
    """The parameter rows when there are at most ``limit`` of them, else None
    (one bounded job answers both questions)."""
    rows = getattr(weights, "_driver_rows", None)
    if rows is None:
        rows = weights.select("candidate_id", "term", "weight").limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _collect_params(rows):
    cands = sorted({r.candidate_id for r in rows})
    pos = {c: i for i, c in enumerate(cands)}
    bias = [0.0] * len(cands)
    per_term: dict[str, list[float]] = {}
    for r in rows:
        if r.term is None:
            bias[pos[r.candidate_id]] += float(r.weight)
        else:
            per_term.setdefault(r.term, [0.0] * len(cands))[pos[r.candidate_id]] += float(r.weight)
    return cands, bias, per_term


def _inline_parts(text: Column, bias, per_term):
    """(hits, logits_of): the row's tokens that the model knows, and a function
    turning such a hits column into the array of logits (one per candidate),
    computed inside the row."""
    b = F.array(*[F.lit(x) for x in bias])
    if not per_term:
        return F.array().cast("array<string>"), lambda h: b
    wmap = F.create_map(
        *[x for term, ws in sorted(per_term.items()) for x in (F.lit(term), F.array(*[F.lit(w) for w in ws]))]
    )
    hits = F.filter(tokens(text), lambda t: F.map_contains_key(wmap, t))

    def logits_of(h: Column) -> Column:
        return F.aggregate(h, b, lambda acc, t: F.zip_with(acc, F.element_at(wmap, t), lambda a, w: a + w))

    return hits, logits_of


def score_terms(
    df: DataFrame,
    weights: DataFrame,
    text_col: str = "text",
    key_cols=None,
    out_col: str = "logit",
    strategy: str = "auto",
    keep_hits: bool = False,
) -> DataFrame:
    """One row per (input row, candidate): input columns except the text,
    plus ``candidate_id`` and ``out_col``.

    ``keep_hits`` also returns ``hits``: the row's known tokens, one entry per
    occurrence, for gradients that must not re-read the text. ``key_cols`` is
    accepted for either strategy; neither needs it.
    """
    small = None
    if strategy in ("auto", "inline"):
        small = _small_params(weights, INLINE_MAX if strategy == "auto" else 50 * INLINE_MAX)
    if strategy == "auto":
        strategy = "inline" if small is not None else "join"
    keep = [c for c in df.columns if c != text_col]
    if strategy == "inline":
        if small is None:
            raise ValueError("parameter table too large to inline; use strategy='join'")
        cands, bias, per_term = _collect_params(small)
        ids = F.array(*[F.lit(c) for c in cands])
        hits, logits_of = _inline_parts(F.col(text_col), bias, per_term)
        extra = ["hits"] if keep_hits else []
        return (
            df.select(*keep, hits.alias("hits"))
            .select(*keep, *extra, F.posexplode_outer(logits_of(F.col("hits"))).alias("_ci", out_col))
            .select(*keep, F.element_at(ids, F.col("_ci") + 1).alias("candidate_id"), out_col, *extra)
        )
    if strategy != "join":
        raise ValueError(f"unknown strategy {strategy!r}")
    return _score_by_join(df, weights, text_col, keep, out_col, keep_hits)


def _score_by_join(df: DataFrame, weights: DataFrame, text_col: str, keep: list, out_col: str, keep_hits: bool) -> DataFrame:
    """Logits through a join on the term, from one scan of ``df``.

    A row's tokens are counted per term before the join (the row's entries lie
    in one task, so the partial aggregate collapses them before the shuffle);
    the bias is one more entry, of term NULL, so rows without a known term
    keep it and nothing is joined back. Parameters within the broadcast bound drop unknown
    words before anything is shuffled, and a row's entries meet once for all candidates. A row is named by its kept columns and a digest of its text, never by a number
    that a task run again could give differently; rows equal in both are one with the count of its bias entries, and
    come apart at the end. The parameters meet the entries as one
    array of weights per term; a very frequent word is a skewed join key that
    AQE splits when the parameters are too many to broadcast."""
    cands = candidate_ids(weights)
    ids = F.array(*[F.lit(c) for c in cands])
    own = F.map_from_entries(F.collect_list(F.struct("candidate_id", "w")))
    per_term = (
        weights.groupBy("term", "candidate_id")
        .agg(F.sum("weight").alias("w"))
        .unionByName(_no_bias(weights.sparkSession, cands, weights))
        .groupBy("term", "candidate_id")
        .agg(F.sum("w").alias("w"))
        .groupBy("term")
        .agg(own.alias("_own"))
        .select("term", F.transform(ids, lambda c: F.coalesce(F.col("_own")[c], F.lit(0.0))).alias("_ws"))
    )
    fits = weights.count() <= BROADCAST_MAX_ROWS
    if fits:
        per_term = F.broadcast(per_term)
    named = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("_kept"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("_row"),
        F.concat(F.array(F.lit(None).cast("string")), tokens(F.col(text_col))).alias("_ts"),
    )
    entries = named.select("_kept", "_row", F.explode("_ts").alias("_t"))
    if fits:
        known_terms = F.broadcast(per_term.select("term"))
        entries = entries.join(known_terms, entries["_t"].eqNullSafe(known_terms["term"]), "left_semi")
    counted = entries.groupBy("_kept", "_row", "_t").agg(F.count(F.lit(1)).alias("_n"))
    met = counted.join(per_term, counted["_t"].eqNullSafe(per_term["term"]))
    no_term = F.col("_t").isNull()
    copies = F.max(F.when(no_term, F.col("_n"))).alias("_copies")
    if fits:
        each = met.groupBy("_kept", "_row").agg(copies, F.array_sort(F.collect_list(F.struct("_t", "_n", "_ws"))).alias("_met"))
        zero = F.array(*[F.lit(0.0) for _ in cands])
        sums = F.aggregate("_met", zero, lambda acc, x: F.zip_with(acc, x["_ws"], lambda a, w: a + x["_n"] * w))
        known = [F.filter("_met", lambda x: x["_t"].isNotNull()).alias("_known")] if keep_hits else []
        rows = each.select("_kept", "_row", "_copies", *known, F.posexplode(sums).alias("_ci", "_sum"))
    else:
        known = [F.collect_list(F.when(~no_term, F.struct("_t", "_n"))).alias("_known")] if keep_hits else []
        rows = (
            met.select("_kept", "_row", "_t", "_n", F.posexplode("_ws").alias("_ci", "_w"))
            .groupBy("_kept", "_row", "_ci")
            .agg(copies, F.sum(F.col("_n") * F.col("_w")).alias("_sum"), *known)
        )
    copies = F.col("_copies")
    hits = [F.flatten(F.transform("_known", lambda x: F.array_repeat(x["_t"], (x["_n"] / copies).cast("int")))).alias("hits")] if keep_hits else []
    return rows.select(
        *[F.col(f"_kept.`{c}`") for c in keep], F.element_at(ids, F.col("_ci") + 1).alias("candidate_id"), (F.col("_sum") / copies).alias(out_col), *hits,
        F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy"),
    ).drop("_copy")


def _no_bias(spark: SparkSession, cands: list, weights: DataFrame) -> DataFrame:
    """A bias of zero for every candidate: added to its own, if it has one."""
    types = {f.name: f.dataType for f in weights.schema.fields}
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("candidate_id", types["candidate_id"]), T.StructField("w", T.DoubleType())])
    return spark.createDataFrame([(None, c, 0.0) for c in cands], schema)


def class_logits(df: DataFrame, key_cols, logit_col: str = "logit", out_col: str = "class_logits") -> DataFrame:
    """Per-class logit arrays from a per-(row, candidate) score: element i+1 is
    the logit of candidate (class) i. Rows are grouped by key; each group holds
    one value per class, so the array stays small."""
    key_cols = list(key_cols)
    return df.groupBy(*key_cols).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("candidate_id", logit_col))), lambda s: s[logit_col]
        ).alias(out_col)
    )


#: Models that a Python worker keeps, the last used ones; by the digest of their loader.
MODELS_KEPT = 2
_models: dict[str, Callable[[list], list]] = {}


def worker_model(key: str, loader: Callable[[], Callable[[list], list]]) -> Callable[[list], list]:
    """The model of ``loader``, built when this worker process first meets ``key`` and kept for its later tasks."""
    model = _models.pop(key, None) or loader()
    _models[key] = model
    while len(_models) > MODELS_KEPT:
        _models.pop(next(iter(_models)))
    return model


def recut(frames: Iterator[pd.DataFrame], size: int) -> Iterator[list[pd.DataFrame]]:
    """The rows of ``frames`` in batches of ``size`` (lists of slices): all but the last are full, wherever frames end."""
    held, n = [], 0
    for frame in frames:
        at = 0
        while n + len(frame) - at >= size:
            held.append(frame.iloc[at : at + size - n])
            yield held
            at += size - n
            held, n = [], 0
        if at < len(frame):
            held.append(frame.iloc[at:])
            n += len(frame) - at
    if held:
        yield held


def score_with(
    df: DataFrame,
    loader: Callable[[], Callable[[list], list]],
    text_col: str = "text",
    batch_size: int = 12,
    out_col: str = "logit",
) -> DataFrame:
    """Score any Python model over Arrow batches.

    ``loader()`` builds the model, once in each Python worker process, which keeps it for its later tasks, and
    returns a callable mapping a list of texts, or a list of lists of texts (ragged groups), to logits of
    the same shape. Rows are cut into calls of ``batch_size`` texts across Arrow batches: only a partition's last
    call may be smaller. Scored rows go on about an Arrow batch at a time.
    Output: the input columns except the text (it is not sent back from
    Python), plus ``out_col`` (double, or array<double> when the text column is
    an array).
    """
    field = df.schema[text_col]
    nested = isinstance(field.dataType, T.ArrayType)
    out_type = T.ArrayType(T.DoubleType()) if nested else T.DoubleType()
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType(kept + [T.StructField(out_col, out_type, True)])

    if batch_size < 1:
        raise ValueError("a batch holds one text at least")
    key = hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, parts, outs = None, [], []

        def scored() -> pd.DataFrame:
            res = pd.concat(parts, ignore_index=True)
            res[out_col] = [list(map(float, o)) for o in outs] if nested else [float(o) for o in outs]
            return res

        for slices in recut(batches, batch_size):
            model = model or worker_model(key, loader)
            texts = [t for s in slices for t in s[text_col].tolist()]
            outs.extend(model([list(x) if x is not None else [] for x in texts] if nested else texts))
            parts += [s.drop(columns=[text_col]) for s in slices]
            if len(outs) >= max(SCORED_ROWS, batch_size):
                yield scored()
                parts, outs = [], []
        if parts:
            yield scored()

    return df.mapInPandas(run, schema)


def lexicon_scorer(weight: float = CANDIDATE_WEIGHTS[0], bias: float = LEXICON_BIAS, terms=tuple(LEXICON)):
    """Loader for a pure-Python twin of candidate 0 (used to exercise score_with)."""

    def load():
        import re

        split = re.compile("[^a-z]+")
        vocab = set(terms)

        def one(text: str) -> float:
            return bias + weight * sum(1 for t in split.split((text or "").lower()) if t in vocab)

        def model(batch):
            if batch and isinstance(batch[0], list):
                return [[one(t) for t in group] for group in batch]
            return [one(t) for t in batch]

        return model

    return load


def pad_batches(
    df: DataFrame,
    key: str,
    text_col: str = "text",
    max_len: int = 512,
    size: int = 12,
    seed: int = 42,
    pad: str = "<pad>",
) -> DataFrame:
    """Token batches as a corpus job: whitespace tokens truncated to
    ``max_len``, rows cut into batches of ``size`` in seeded order, each row
    padded to the longest row **of its batch**:
    ``(key, batch_id, n_tokens, batch_max, tokens)``.

    The tokens move once: the seeded order is that of a uniform hash, so its first digits are the range that a row goes to
    (no sampling), where rows are sorted and written once, as one string a row. The sizes of the ranges make places
    batch numbers. A batch then lies in one range, but for those across the ends of ranges, whose longest rows are looked up
    first (at most one for each range reaches the driver); padding happens where the rows are."""
    from ..functions.scalar import whitespace_tokens
    from .prep import LOCAL_BITS, order_key

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = F.slice(whitespace_tokens(F.col(text_col)), 1, max_len)
    staged = df.select(key, order_key(key, seed).alias("_ok"), cut.alias("_t"))
    staged = staged.select(key, "_ok", F.size("_t").alias("n_tokens"), F.array_join("_t", " ").alias("_t"))
    at = F.shiftright(F.conv(F.substring("_ok", 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    tagged = staged.repartitionById(n, at).sortWithinPartitions("_ok", key).drop("_ok").withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    pid, local = F.shiftright("_mid", LOCAL_BITS), F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    starts, total = {}, 0
    for r in sorted(tagged.groupBy(pid.alias("p")).count().collect()):  # a row for each range
        starts[r["p"]], total = total, total + r["count"]
    starts = starts or {0: 0}
    first = F.element_at(F.create_map(*[F.lit(x) for p, o in starts.items() for x in (p, o)]), pid)
    placed = tagged.select(key, "n_tokens", "_t", F.floor((first + local) / F.lit(size)).cast("bigint").alias("batch_id"))
    across = sorted({o // size for o in starts.values() if o % size})
    found = placed.where(F.col("batch_id").isin(across)).groupBy("batch_id").agg(F.max("n_tokens").alias("m")).collect() if across else []
    longest = {r["batch_id"]: r["m"] for r in found}
    with_max = placed.mapInArrow(batch_longest(longest), f"`{key}` {dict(placed.dtypes)[key]}, n_tokens int, _t string, batch_id long, batch_max int")
    own = F.when(F.col("n_tokens") > 0, F.split("_t", " ")).otherwise(F.array().cast("array<string>"))
    return with_max.select(
        key,
        "batch_id",
        "n_tokens",
        "batch_max",
        F.concat(own, F.array_repeat(F.lit(pad), F.col("batch_max") - F.col("n_tokens"))).alias("tokens"),
    )


def batch_longest(known: dict[int, int]):
    """For ``mapInArrow``: rows in the order of ``batch_id`` with ``batch_max``, their batch's largest ``n_tokens``; for the
    batches in ``known`` the one given there. Holds an Arrow batch and a batch."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n = table["batch_id"].to_numpy(), table["n_tokens"].to_numpy()
        begins = np.flatnonzero(np.diff(ids, prepend=-1))
        most = np.maximum.reduceat(n, begins)
        most = np.array([known.get(i, m) for i, m in zip(ids[begins].tolist(), most.tolist(), strict=True)], np.int32)
        whole = table.append_column("batch_max", pa.array(np.repeat(most, np.diff(np.append(begins, len(ids))))))
        yield from whole.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            ids = table["batch_id"].to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last batch may go on
            if whole:
                yield from done(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None:
            yield from done(held)

    return run


def padding_report(padded: DataFrame) -> DataFrame:
    """Per batch: rows, longest row, real tokens and padding tokens."""
    return padded.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("batch_max").alias("max_tokens"),
        F.sum("n_tokens").alias("real_tokens"),
        F.sum(F.col("batch_max") - F.col("n_tokens")).alias("pad_tokens"),
    )


def score_arrays(df: DataFrame, weights: DataFrame, text_col: str = "text", key_cols=None, out_col: str = "logits"):
    """Like :func:`score_terms` but one row per input row, with an array of
    logits ordered by candidate id. Returns ``(frame, candidate_ids)``.

    Inline for small models (no shuffle); otherwise the join strategy
    followed by a per-row regrouping of its K values."""
    keep = [c for c in df.columns if c != text_col]
    small = _small_params(weights, INLINE_MAX)
    if small is not None:
        cands, bias, per_term = _collect_params(small)
        hits, logits_of = _inline_parts(F.col(text_col), bias, per_term)
        return df.select(*keep, logits_of(hits).alias(out_col)), cands
    if not key_cols:
        raise ValueError("large models need key_cols that identify a row")
    cands = candidate_ids(weights)
    long = score_terms(df, weights, text_col=text_col, key_cols=key_cols, strategy="join")
    rest = [c for c in keep if c not in key_cols]
    arr = class_logits(long, list(key_cols) + rest, out_col=out_col)
    return arr, cands
