"""Stand-ins for the two absent inputs, built from the given test tables.

* primary (labelled text): ``documents`` joined with ``labels`` on doc_id,
  ``label := toxic``;
* text groups, long form ``(group_id, pos, text)``: documents grouped by
  columns (``lang, source`` or ``source``), or conversations by conv_id.

Groups are kept in long form: one row per member. A group is never gathered
into one array here, so a group holding a third of all rows still spreads
over every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash60
from ..session import load_table


def primary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, label)`` for every labelled document.

    The labels side is broadcast when its checked size allows (no shuffle of
    texts); otherwise the planner shuffles both sides. Scoring paths use
    :func:`labelled_logits`, which never shuffles texts."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    if labels_fit_broadcast(labels):
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id")


def group_id_of(*cols) -> F.Column:
    """Stable 60-bit id of a group key (md5 of the marked key values), the same in
    any SQL engine with md5. Two keys collide with probability about
    n^2 / 2^61 for n distinct keys (4e-5 at ten million groups); group tables
    that arrive with their own ids keep them."""
    return hash60(F.lit("group"), *[marked(F.col(c).cast("string")) for c in cols])


def marked(value: F.Column) -> F.Column:
    """A key part that no other parts can imitate: its length and itself, or
    ``-`` for NULL, so ('a:b', 'c'), ('a', 'b:c'), (NULL, 'c') and ('c', NULL) differ."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit("="), value), F.lit("-"))


def document_groups(spark: SparkSession, sf_dir: str, by=("lang", "source")) -> DataFrame:
    """Documents grouped by columns: ``(group_id, pos, text)``; pos = doc_id."""
    docs = load_table(spark, sf_dir, "documents")
    return docs.select(group_id_of(*by).alias("group_id"), F.col("doc_id").alias("pos"), "text")


def conversation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as groups: ``(group_id, pos, text)``; pos = turn."""
    conv = load_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), "text")


# Broadcast cap for the labels side of the labelled-text join, in rows. A
# label row is (doc_id bigint, label int): 8 M rows stay near 200 MB in a
# broadcast hash relation.
LABELS_BROADCAST_MAX_ROWS = 8_000_000


def labels_fit_broadcast(labels: DataFrame) -> bool:
    """Whether ``(doc_id, label)`` rows may be broadcast: a row count against
    ``LABELS_BROADCAST_MAX_ROWS``, summed from one number per task."""
    return labels.count() <= LABELS_BROADCAST_MAX_ROWS


def labelled_logits(spark: SparkSession, sf_dir: str, weights: DataFrame, exploded: bool = True) -> DataFrame:
    """Scores of every labelled document; whole texts never cross a shuffle.

    The join order is chosen from the checked size of the labels side:

    * labels within ``LABELS_BROADCAST_MAX_ROWS``: broadcast them and join
      first — only labelled documents are scored, nothing is shuffled;
    * larger: score documents where they are read (a narrow projection) and
      join only ``(doc_id, logits)`` with the labels (shuffle of small rows).

    ``exploded``: one row per (doc, candidate) with ``candidate_id, logit``;
    otherwise one row per doc with the ``logits`` array.
    Returns ``(frame, candidate_ids)``."""
    from ..operators.score import score_arrays

    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    if labels_fit_broadcast(labels):
        arr, cands = score_arrays(docs.join(F.broadcast(labels), "doc_id"), weights, key_cols=["doc_id"])
        joined = arr
    else:
        arr, cands = score_arrays(docs, weights, key_cols=["doc_id"])
        joined = arr.join(labels, "doc_id")
    if not exploded:
        return joined.select("doc_id", "label", "logits"), cands
    ids = F.array(*[F.lit(c) for c in cands])
    out = joined.select("doc_id", "label", F.posexplode_outer("logits").alias("_ci", "logit")).select(
        "doc_id", "label", F.element_at(ids, F.col("_ci") + 1).alias("candidate_id"), "logit"
    )
    return out, cands


def labelled_hits(spark: SparkSession, sf_dir: str, weights: DataFrame) -> DataFrame:
    """``(doc_id, label, candidate_id, logit, hits)`` for gradients, with the
    same size-checked join order as :func:`labelled_logits`."""
    from ..operators.score import score_terms

    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    if labels_fit_broadcast(labels):
        return score_terms(docs.join(F.broadcast(labels), "doc_id"), weights, keep_hits=True)
    return score_terms(docs, weights, keep_hits=True).join(labels, "doc_id")


def labels_table(spark: SparkSession, sf_dir: str):
    """``(doc_id, label)`` and whether its checked size allows a broadcast."""
    labels = load_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return labels, labels_fit_broadcast(labels)
