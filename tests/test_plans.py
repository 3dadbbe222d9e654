"""Plan-shape checks: the properties the scale design relies on."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from varguard.operators.measures import vprob
from varguard.operators.nested import chop_groups
from varguard.operators.score import lexicon_model, score_terms
from varguard.operators.train import variance_gradient
from varguard.sources.standins import document_groups


def plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_variance_is_combined_map_side(spark):
    members = score_terms(document_groups(spark, SF_SMALL), lexicon_model(spark), key_cols=["group_id", "pos"])
    assert "partial_var_samp" in plan(vprob(members))


def test_chop_limits_before_the_shuffle(spark):
    p = plan(chop_groups(document_groups(spark, SF_SMALL).select("group_id", "pos"), 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_inline_scoring_has_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    p = plan(score_terms(docs, lexicon_model(spark)))
    assert "Exchange" not in p


@pytest.mark.parametrize("name", ["flagship_safety_report", "ex1_run_experiment"])
def test_corpus_is_scanned_once(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert p.count("documents.parquet") == 1
    assert "SortMergeJoin" not in p  # labels are small here: broadcast, texts stay put


def test_filter_and_projection_reach_the_scan(spark, tmp_path):
    from varguard.sources.text import labelled_from_primary, read_labelled_text
    from varguard.sources.standins import primary_table

    path = str(tmp_path / "labelled")
    labelled_from_primary(primary_table(spark, SF_SMALL)).write.parquet(path)
    df = read_labelled_text(spark, path, "parquet").filter(F.col("split") == "train").select("text", "label")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(split), EqualTo(split,train)]" in p
    assert "ReadSchema: struct<text:string,label:int,split:string>" in p


def test_hot_group_results_are_exact(spark):
    # one group holds a third of all rows; results equal a direct computation
    rows = [(0, i, "idiot" if i % 3 == 0 else "fine") for i in range(600)]
    rows += [(g, i, "stupid" if (g + i) % 2 else "ok") for g in range(1, 201) for i in range(6)]
    df = spark.createDataFrame(rows, "group_id long, pos long, text string").repartition(8)
    w = lexicon_model(spark, (1.0,))
    v = {r.group_id: r.vprob for r in vprob(score_terms(df, w, key_cols=["group_id", "pos"])).collect()}
    import statistics, math
    p1, p0 = 1 / (1 + math.exp(1.0)), 1 / (1 + math.exp(2.0))
    want0 = statistics.variance([p1 if i % 3 == 0 else p0 for i in range(600)])
    assert v[0] == pytest.approx(want0, rel=1e-12)
    g = variance_gradient(df, w).collect()
    assert sorted(r.term or "" for r in g) == ["", "idiot", "stupid"]  # bias + the two terms seen


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not any(x in n for x in ("snk", "stream"))))
def test_every_query_reads_the_corpus_at_most_once(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()  # final adaptive plan of this frame
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert final.count("documents.parquet") <= 1
