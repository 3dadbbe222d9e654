import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from varguard.operators.nested import chop_groups, exact_quantile, expand_terms, flatten_groups, renest
from varguard.operators.prep import assign_batches, dense_index, split_safety


def test_dense_index_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b long").repartition(7)
    got = dense_index(df, ["a", "b"], "idx", num_partitions=5).select("a", "b", "idx").collect()
    want = sorted(rows)
    assert sorted((r.idx, r.a, r.b) for r in got) == [(i, a, b) for i, (a, b) in enumerate(want)]


def test_split_is_disjoint_complete_and_grouped(spark):
    df = spark.createDataFrame([(g, m) for g in range(300) for m in range(3)], "group_id long, pos long")
    parts = split_safety(df, "group_id").groupBy("group_id").agg(F.countDistinct("part").alias("k")).collect()
    assert len(parts) == 300 and all(r.k == 1 for r in parts)
    share = split_safety(df, "group_id").filter("part = 'safety'").count() / df.count()
    assert 0.5 < share < 0.7


def test_batches_cover_each_epoch_once(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    b = assign_batches(df, "doc_id", 12, epochs=3)
    per_epoch = b.groupBy("epoch").agg(F.countDistinct("doc_id").alias("n"), F.max("batch_id").alias("mb")).collect()
    assert sorted((r.epoch, r.n, r.mb) for r in per_epoch) == [(0, 50, 4), (1, 50, 4), (2, 50, 4)]


def test_flatten_then_renest_is_identity(spark):
    groups = [(1, ["a", "b", "c"]), (2, ["x"]), (3, ["p", "q"])]
    df = spark.createDataFrame(groups, "group_id long, text_groups array<string>")
    back = renest(flatten_groups(df), "text", out_col="text_groups").collect()
    assert sorted((r.group_id, r.text_groups) for r in back) == groups


def test_chop_keeps_first_k(spark):
    df = spark.createDataFrame([(1, p) for p in range(10)] + [(2, 5)], "group_id long, pos long")
    got = sorted((r.group_id, r.pos) for r in chop_groups(df, 3).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 5)]


def test_exact_quantile_matches_linear_interpolation(spark):
    vals = [float(v) for v in [5, 1, 3, 3, 9, 7, 2]]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    s = sorted(vals)
    h = 0.9 * (len(s) - 1)
    want = s[int(h)] + (h - int(h)) * (s[int(h) + 1] - s[int(h)])
    assert abs(exact_quantile(df, "v", 0.9) - want) < 1e-12


def test_expand_terms(spark):
    df = spark.createDataFrame([(1, "He said he was here. The hero left."), (2, "nothing")], "doc_id long, text string")
    rows = sorted((r.group_id, r.pos, r.text) for r in expand_terms(df).collect())
    assert [r[2] for r in rows] == [
        "he said he was here. The hero left.",
        "she said she was here. The hero left.",
        "they said they was here. The hero left.",
    ]


def test_dense_index_when_range_bounds_are_sampled(spark):
    # far more rows than the range partitioner samples: bounds come from a sample
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 10**9), i) for i in range(30000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = dense_index(df, ["a", "b"], "idx", num_partitions=16).select("a", "b", "idx").collect()
    want = {ab: i for i, ab in enumerate(sorted(rows))}
    assert len(got) == len(rows)
    assert all(want[(r.a, r.b)] == r.idx for r in got)


def test_pad_batches_pads_to_batch_maximum(spark):
    from varguard.operators.score import pad_batches

    df = spark.createDataFrame([(i, " ".join(["w"] * (i + 1))) for i in range(7)], "doc_id long, text string")
    rows = pad_batches(df, "doc_id", max_len=4, size=3).collect()
    assert len(rows) == 7
    for r in rows:
        assert len(r.tokens) == r.batch_max and r.n_tokens == min(r.doc_id + 1, 4)
        assert r.tokens[r.n_tokens:] == ["<pad>"] * (r.batch_max - r.n_tokens)


def test_renest_refuses_oversized_groups(spark):
    import pytest

    df = spark.createDataFrame([(1, p, "t") for p in range(50)], "group_id long, pos long, text string")
    with pytest.raises(ValueError):
        renest(df, "text", max_members=10)
    assert renest(df, "text", max_members=50).count() == 1
