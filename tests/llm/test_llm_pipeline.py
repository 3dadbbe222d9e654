"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import importlib.util

import pytest
from pyspark.sql import functions as F

from varguard.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_pipeline(spark):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src0", 0)], table.schema)
    docs = table.union(extra).withColumnsRenamed({"n_chars": "slot"})  # an extra column with a clashing name
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = p.written(stage(spark, before, SF), name)
        assert docs.columns == before.columns
        if name == "quality":
            left = {r["doc_id"] for r in docs.collect()}
            wrong = sum((i in left) != bool(q) for i, q in quality.items())
            assert wrong <= 0.05 * len(quality)
        if name == "exact_dedup":
            texts = [" ".join((r["text"] or "").split()) for r in docs.where("doc_id IS NOT NULL").collect()]
            assert len(texts) == len(set(texts))
        if name == "mix":
            assert sorted(map(str, docs.collect())) == sorted(map(str, before.collect()))
    out = p.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("round_trip = false").count() == 0
    assert p.run(spark, SF).count() > 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_run_keeps_the_mixed_order(spark, monkeypatch):
    """The rows of run() stand in the order of the schedule, though the mixed table has many files of different sizes."""
    import corpus_pipeline as p
    from varguard.llm.pfair_mix import mix_sources, root_weights

    stored = {}

    def keeping(df, name):
        stored[name] = p_written(df, name)
        return stored[name]

    p_written = p.written
    monkeypatch.setattr(p, "written", keeping)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = p.run(spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(stored["mix"].inputFiles()) > 4
    before = stored["near_dedup"]
    mixed = mix_sources(before, root_weights(before)).orderBy("slot", F.xxhash64("doc_id", F.lit("mix")))
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in mixed.select("doc_id").collect()]
    assert [r["mixed_place"] for r in rows] == list(range(len(rows)))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_near_keeps_a_row_of_each_component(spark):
    """An id with two texts: the copy of another's goes, the text that represents its component stays."""
    import corpus_pipeline as p

    x, y = " ".join(f"river{i}" for i in range(60)), " ".join(f"stone{i}" for i in range(60))
    docs = spark.createDataFrame([(3, x), (7, x), (7, y), (9, y), (None, y)], "doc_id long, text string")
    assert sorted(map(tuple, p.near(spark, docs, SF).collect()), key=str) == sorted([(3, x), (7, y), (None, y)], key=str)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_stages_on_empty_and_null_tables(spark):
    """Empty tables stay empty; rows of nulls only are never dropped as copies or rejected by an untrained model."""
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(None).cast("string")).withColumn("fingerprint", F.lit(None).cast("int"))
    nulls = spark.createDataFrame([(None,) * len(table.columns)] * 3, table.schema)
    for name, stage in p.STAGES:
        out = stage(spark, table.limit(0), SF)
        assert out.count() == 0, name
        assert stage(spark, nulls, SF).count() == 3, name
        if name != p.STAGES[-1][0]:
            assert out.columns == table.columns


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_stages_keep_columns_with_internal_names(spark):
    import corpus_pipeline as p

    names = ["score", "_score", "sha", "fp", "_fp", "gone_id", "_gone_key", "mixed_slot", "_mixed_slot", "_mix_h", "_mix_s", "_mix_n", "_mix_b", "_mix_row", "_mix_x"]
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = table.withColumns({n: F.concat(F.lit(f"{n}:"), "doc_id") for n in names})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in names)
