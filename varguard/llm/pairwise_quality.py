"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a text marked good, one marked bad) are learnt by logistic
loss on the difference of their features: the chance that a text is preferred is
the sigmoid of the difference of two scores. Scores then need a threshold, which is the
quantile of the training texts' scores that leaves as many below as are marked bad.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training uses at most, the first by hash of their id.
MAX_TRAIN = 20000
#: Preference pairs that each good training text takes part in.
PAIRS_EACH = 8
STEPS, L2 = 60, 1e-3


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: bytes) -> list[float]:
    """How a text is written, from all of its bytes; lengths enter by logarithm."""
    n = max(1, len(text))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    count = max(1, len(words))
    several = max(1, len(words) - 1)
    distinct = len(set(words)) / count
    per_word = lambda marks: float(byte[list(marks)].sum()) / count
    return [
        byte[65:91].sum() / n,
        byte[97:123].sum() / n,
        byte[48:58].sum() / n,
        per_word(b"!?"),
        per_word(b"#$%&*@^~"),
        per_word(b"|"),
        per_word(b"<>{};=\\/"),
        per_word(b".,"),
        per_word(b"\n"),
        byte[128:].sum() / n,
        float(np.log1p(len(words))),
        float(np.log1p(len(text))),
        distinct,
        distinct * float(np.log1p(len(words))),
        len(set(zip(words, words[1:]))) / several,  # noqa: B905
        len(text) / count,
        len(set(lines)) / len(lines),
        max(map(len, words), default=0) ** 0.5,
        sum(a == b for a, b in zip(words, words[1:])) / several,  # noqa: B905
    ]


N_FEATURES = len(features(b""))


def feature_table(texts: DataFrame, carry: list[str]) -> DataFrame:
    """``texts`` with its ``text`` column replaced by ``x``, the features."""
    schema = ", ".join(f"`{c}` {dict(texts.dtypes)[c]}" for c in carry) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch["text"]]
            yield pa.record_batch({c: batch[c] for c in carry} | {"x": pa.array(x, pa.list_(pa.float64()))})

    return texts.mapInArrow(run, schema)


@dataclass(frozen=True)
class PairwiseModel:
    """``score = 1 / (1 + exp(threshold - weights . x))``, x standardised."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ np.array(self.weights) - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def train_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_train: int) -> DataFrame:
    """``(id, label, text)`` of the documents of at most ``max_train`` labels that aren't held out.
    Labels are picked before any text moves; an id that several documents have brings all of them."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = (
        marked.where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "label").limit(max_train)
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    return texts.join(F.broadcast(picked), "id")  # max_train labels at most


def fit(x: np.ndarray, label: np.ndarray, ids: np.ndarray) -> PairwiseModel:
    """Newton steps on the pairs' logistic loss. Without rows of both labels
    nothing can be learnt: every score is then 1/2 or more (nothing is rejected)."""
    if not (label == 1).any() or not (label == 0).any():
        return PairwiseModel([0.0] * N_FEATURES, [1.0] * N_FEATURES, [0.0] * N_FEATURES, 0.0)
    order = np.lexsort((label, ids))  # the result doesn't depend on the order in which rows came
    x, label, ids = x[order], label[order], ids[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    good = np.repeat(good, PAIRS_EACH)
    with_bad = [zlib.crc32(f"{ids[g]}:{i % PAIRS_EACH}".encode()) % len(bad) for i, g in enumerate(good.tolist())]
    diff = z[good] - z[bad[with_bad]]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # chance that the bad one is preferred
        slope = diff.T @ p / len(diff) - L2 * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + L2 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    raw = z @ w
    # between the last text below the quantile and the first above it
    below = int((label == 0).sum())
    ranked = np.sort(raw)
    return PairwiseModel(mean.tolist(), scale.tolist(), w.tolist(), float((ranked[below - 1] + ranked[below]) / 2))


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN) -> PairwiseModel:
    """The model learnt from ``labels(doc_id, quality)``, from ``max_train`` rows at most: where ids repeat
    in ``docs``, equal rows count once and the first by hash are taken."""
    found = feature_table(train_rows(docs, labels, label_col, max_train), ["id", "label"]).distinct()
    rows = found.orderBy(F.xxhash64("id", "x"), "id", "label", "x").limit(max_train).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES)
    return fit(x, np.array([r["label"] for r in rows], int), np.array([r["id"] for r in rows], np.int64))


def with_score(docs: DataFrame, model: PairwiseModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, 0 to 1, from the whole text alone (null: as empty)."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([features(t.encode() if isinstance(t, str) else b"") for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.Series(model.scores(x))

    return docs.withColumn(score_col, score(F.col(text_col)))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts are scored like any other, repeated rows each, very long texts whole.
    Labels that are null, or on null or unknown ids, are ignored; a label
    given several times counts once. An empty table gives an empty result, empty
    ``labels`` score 1/2. Other columns are never looked at.
    """
    model = train_quality(docs, labels, label_col, max_train)
    texts = docs.select("doc_id", "text")
    return with_score(texts, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
