"""The corpus pipeline: each stage works on all that the one before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``. A row without ``doc_id`` is never dropped as a
copy: it can't be told from others. Rows that share an id are judged each by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varguard.llm.chunk_dedup import exact_dedup, normalised
from varguard.llm.common import read, written
from varguard.llm.pairwise_quality import train_quality, with_score
from varguard.llm.pfair_mix import in_mixed_order, mix_sources, root_weights, with_stored_place
from varguard.llm.piece_tokenizer import encode_texts, load_vocabulary
from varguard.llm.simhash import simhash_groups, with_fingerprint


def same_columns(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.select(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as keep it apart from the start of any column of ``docs``."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = "_" + name
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise classifier scores 1/2 or more."""
    model = train_quality(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return same_columns(with_score(docs, model, score_col=score).where(F.col(score) >= 0.5), docs)


def without(keyed: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (the columns of ``docs`` and a key) whose id and key aren't in ``gone``."""
    key, name = keyed.columns[-1], free_name(keyed, "gone")
    gone = gone.toDF(f"{name}_id", f"{name}_key")
    return same_columns(keyed.join(gone, (F.col("doc_id") == F.col(f"{name}_id")) & (F.col(f"`{key}`") == F.col(f"{name}_key")), "left_anti"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the smallest id."""
    copies = exact_dedup(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id", "text_sha256").distinct()
    return without(docs.withColumn(free_name(docs, "sha"), F.sha2(normalised(F.col("text")), 256)), copies, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id. Where rows of an id have
    different texts, each is judged by its own."""
    copies = simhash_groups(docs, words=3, max_bits=3).where("doc_id <> component_id").select("doc_id", "fingerprint").distinct()
    return without(with_fingerprint(docs, free_name(docs, "fp"), words=3), copies, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the Pfair schedule."""
    prefix = free_name(docs, "mixed_")
    return in_mixed_order(mix_sources(docs, root_weights(docs), prefix=prefix), docs.columns, f"{prefix}slot")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, each decoded again and compared, in the mixed order; ``mixed_place`` is a document's place in it."""
    placed = with_stored_place(docs.select("doc_id", "text"), "mixed_place")
    return encode_texts(placed.orderBy("mixed_place"), load_vocabulary(), place_col="mixed_place")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("tokens", tokens)]

#: Trained models, rolling hashes and tokenizers: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
