"""Models kept by workers, batches across Arrow batches, trial files named by cells, chunked groups."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from varguard.operators import score
from varguard.operators.nested import chunk_groups, flatten_chunks
from varguard.operators.score import lexicon_scorer, recut, score_with, worker_model
from varguard.sources.named import cell_name, write_named_trials
from varguard.sources.results import read_trials


@pytest.mark.parametrize("sizes,size", [([5, 5, 5], 4), ([1] * 9, 4), ([0, 12, 0], 12), ([30], 7), ([3], 12), ([], 4)])
def test_batches_are_cut_across_frames(sizes, size):
    frames, n = [], 0
    for k in sizes:
        frames.append(pd.DataFrame({"x": range(n, n + k)}))
        n += k
    cut = [[v for s in b for v in s["x"]] for b in recut(iter(frames), size)]
    assert [v for b in cut for v in b] == list(range(n))
    assert all(len(b) == size for b in cut[:-1]) and (not cut or 0 < len(cut[-1]) <= size)


def test_a_model_is_loaded_once_per_worker_and_batches_are_full(spark, tmp_path):
    loads, calls = str(tmp_path / "loads"), str(tmp_path / "calls")
    os.makedirs(loads)
    os.makedirs(calls)

    def loader():
        open(f"{loads}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            open(f"{calls}/{os.getpid()}-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return [len(t or "") for t in texts]

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(2000, numPartitions=16).selectExpr("id", "repeat('x', CAST(id % 7 AS INT)) AS text")
        for _ in range(2):
            got = score_with(df, loader, batch_size=12).collect()
            assert sorted((r["id"], r["logit"]) for r in got) == [(i, float(i % 7)) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pids = [f.split("-")[0] for f in os.listdir(loads)]
    assert len(pids) == len(set(pids)) < 32  # a load for each worker, not for each of 32 tasks
    sizes = [int(f.split("-")[1]) for f in os.listdir(calls)]
    assert sum(sizes) == 4000 and sum(s != 12 for s in sizes) <= 32 and sizes.count(12) >= 32 * 10


def test_a_worker_keeps_few_models(monkeypatch):
    monkeypatch.setattr(score, "_models", {})
    built = []
    load = lambda k: lambda: built.append(k) or (lambda texts: k)
    for k in ("a", "b", "a", "c", "a", "b"):
        assert worker_model(k, load(k))([]) == k
    assert built == ["a", "b", "c", "b"] and len(score._models) == score.MODELS_KEPT


def test_score_with_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert score_with(empty, lexicon_scorer()).count() == 0
    groups = spark.createDataFrame([(1, ["trash", None]), (2, None), (3, [])], "id long, texts array<string>")
    got = {r["id"]: r["logit"] for r in score_with(groups, lexicon_scorer(), text_col="texts", batch_size=2).collect()}
    assert got == {1: [-1.0, -2.0], 2: [], 3: []}
    with pytest.raises(ValueError):
        score_with(empty, lexicon_scorer(), batch_size=0)


def results(spark, rows):
    return spark.createDataFrame(rows, "data_frac double, trial_i int, performance double, passed_safety boolean, gvec array<double>")


ROWS = [(10 ** (-2.5 + i * 2.5 / 9), t, None if t == 1 else 0.1 * i + t / 3, t != 1, [float("-inf")] * 2 if t == 1 else [-0.04, 1e-17]) for i in range(10) for t in range(3)]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_trial_files_are_named_by_their_cell(spark, tmp_path, scheme):
    path = scheme + str(tmp_path / "named")
    write_named_trials(results(spark, ROWS).repartition(4), path)
    assert sorted(os.listdir(tmp_path / "named")) == sorted(cell_name(r[0], r[1]) for r in ROWS)
    assert "data_frac_0.0032_trial_0.csv" in os.listdir(tmp_path / "named")
    back = read_trials(spark, path, "named").collect()
    assert sorted((r["data_frac"], r["trial_i"], r["performance"], r["passed_safety"], r["gvec"]) for r in back if r["performance"]) == sorted(r for r in ROWS if r[2])
    assert all(r["file_trial_i"] == r["trial_i"] and abs(r["file_data_frac"] - r["data_frac"]) <= 5e-5 for r in back) and len(back) == 30


def test_cells_are_replaced_and_folders_overwritten(spark, tmp_path):
    path = str(tmp_path / "named")
    write_named_trials(results(spark, ROWS[:3]), path)
    write_named_trials(results(spark, [(ROWS[0][0], 0, 9.5, True, [0.0]), (1.0, 7, 1.5, True, [0.0])]), path, mode="append")
    got = {(round(r["data_frac"], 4), r["trial_i"]): r["performance"] for r in read_trials(spark, path, "named").collect()}
    assert got == {(0.0032, 0): 9.5, (0.0032, 1): None, (0.0032, 2): ROWS[2][2], (1.0, 7): 1.5}
    write_named_trials(results(spark, ROWS[-1:]), path)
    assert os.listdir(path) == [cell_name(*ROWS[-1][:2])]


def test_a_failed_write_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "named")
    with pytest.raises(Exception, match="share a file name"):
        write_named_trials(results(spark, [(0.00311, 0, 1.0, True, [0.0]), (0.00312, 0, 2.0, True, [0.0])]), path)
    with pytest.raises(Exception, match="needs data_frac"):
        write_named_trials(results(spark, [(None, 0, 1.0, True, [0.0]), (0.5, 0, 2.0, True, [0.0])]).coalesce(1), path)
    assert [f for _, _, fs in os.walk(path) for f in fs] == []


def test_a_hot_group_is_nested_by_many_tasks(spark):
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", i, None if i % 17 == 0 else "x" * (i % 90)) for i in range(3000)] + [(None, 5, "null group"), ("hot", None, "no place")]
    df = spark.createDataFrame(rows, "group_id string, pos long, text string").repartition(6)
    for max_bytes in (None, 200):
        chunks = chunk_groups(df, "text", size=64, max_bytes=max_bytes)
        hot = chunks.where("group_id = 'hot'")
        assert hot.agg(F.max("n_members")).first()[0] <= 64 and hot.count() >= 3000 // 64
        if max_bytes:
            sizes = chunks.select(F.aggregate("texts", F.lit(0), lambda a, t: a + F.coalesce(F.length(t), F.lit(0))).alias("b")).collect()
            assert max(r["b"] for r in sizes) < 200 + 90
        assert "hashpartitioning(group_id#" in (plan := chunks._jdf.queryExecution().toString()) and "chunk#" in plan.split("hashpartitioning(group_id#")[1][:40]
        assert sorted(map(str, flatten_chunks(chunks, "texts", "text").collect())) == sorted(map(str, df.collect()))
        order = hot.orderBy("chunk", "part").select("first_pos").collect()
        assert [r[0] for r in order if r[0] is not None] == sorted(r[0] for r in order if r[0] is not None)
    assert chunk_groups(df.limit(0), "text").count() == 0


def test_padding_in_order_of_batches(spark):
    """Batches across the ends of ranges and of Arrow batches, empty texts, one wide key."""
    import hashlib

    from varguard.operators.score import pad_batches

    rows = [(f"k{i}", None if i % 13 == 0 else " ".join(["w"] * (i * 7 % 29)) + "  \t") for i in range(400)]
    df = spark.createDataFrame(rows, "key string, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for size in (1, 12, 1000):
            order = sorted((k for k, _ in rows), key=lambda k: (hashlib.md5(f"42:order:{k}".encode()).hexdigest(), k))
            n = {k: min(20, len((t or "").split())) for k, t in rows}
            got = {r["key"]: r for r in pad_batches(df, "key", max_len=20, size=size).collect()}
            assert len(got) == 400
            for at, k in enumerate(order):
                batch = order[at // size * size : at // size * size + size]
                r, most = got[k], max(n[x] for x in batch)
                assert (r["batch_id"], r["n_tokens"], r["batch_max"], r["tokens"]) == (at // size, n[k], most, ["w"] * n[k] + ["<pad>"] * (most - n[k]))
        assert pad_batches(df.limit(0), "key").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_join_scorer_names_rows_by_what_they_hold(spark):
    from varguard.operators.score import lexicon_model, score_terms

    rows = [(1, "trash trash the", 0)] * 3 + [(1, "trash trash the", 1), (None, "idiot", 0), (None, None, 0), (None, "", 0), (2, "nothing", 0)]
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(4)
    key = lambda r: (str(r["id"]), r["label"], r["candidate_id"], r["logit"], sorted(r["hits"]))
    a, b = (sorted(map(key, score_terms(df, lexicon_model(spark), strategy=s, keep_hits=True).collect())) for s in ("join", "inline"))
    assert a == b and len(a) == 16
    plan = score_terms(df, lexicon_model(spark), strategy="join")._jdf.queryExecution().toString()
    assert "monotonically" not in plan


@pytest.mark.parametrize("kind", ["even", "ties", "two", "one", "tail"])
def test_quantiles_without_a_sort(spark, kind):
    import numpy as np

    from varguard.operators.nested import exact_quantile

    rng = np.random.default_rng(1)
    x = {"even": rng.normal(size=30_000), "ties": rng.integers(0, 7, 30_000) / 7, "two": np.repeat([0.0, 1.0], [27_000, 3000]), "one": np.zeros(20_000), "tail": rng.pareto(0.5, 25_000)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": range(len(x))})).repartition(6).checkpoint()
    for p in (0.0, 0.5, 0.9, 0.999, 1.0):
        assert exact_quantile(df, "x", p, near_values=100) == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)
    assert exact_quantile(df.limit(0), "x", 0.5) is None and exact_quantile(df.limit(1), "x", 0.3) is not None
