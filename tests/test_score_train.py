import math
import random

import pytest
from pyspark.sql import functions as F

from varguard.operators.score import lexicon_model, lexicon_scorer, score_terms, score_with
from varguard.operators.train import loss_gradient, variance_gradient

TEXTS = [
    "you stupid idiot", "what a lovely day", "trash TRASH trash!", "clown-moron", "nothing here", "Stupid? no.",
    "loser pathetic scum", "fine", "disgusting worthless", "ok ok", "idiot", "a b c",
]


def _docs(spark):
    rows = [(i, t, int(i % 3 == 0)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_inline_and_join_strategies_agree(spark):
    w = lexicon_model(spark)
    d = _docs(spark)
    a = {(r.doc_id, r.candidate_id): r.logit for r in score_terms(d, w, key_cols=["doc_id"], strategy="inline").collect()}
    b = {(r.doc_id, r.candidate_id): r.logit for r in score_terms(d, w, key_cols=["doc_id"], strategy="join").collect()}
    assert a == b
    assert a[(2, 0)] == -2.0 + 3.0 and a[(2, 1)] == -2.0 + 6.0
    assert a[(1, 0)] == -2.0


def test_score_with_flat_and_nested(spark):
    d = _docs(spark)
    flat = {r.doc_id: r.logit for r in score_with(d, lexicon_scorer(), batch_size=5).collect()}
    inline = {r.doc_id: r.logit for r in score_terms(d, lexicon_model(spark, (1.0,)), key_cols=["doc_id"]).collect()}
    assert flat == inline
    g = spark.createDataFrame([(1, ["idiot", "fine"]), (2, ["x"])], "group_id long, text_groups array<string>")
    nested = {r.group_id: r.logit for r in score_with(g, lexicon_scorer(), text_col="text_groups", batch_size=1).collect()}
    assert nested == {1: [-1.0, -2.0], 2: [-2.0]}


def _counts(text, vocab):
    import re

    toks = [t for t in re.split("[^a-z]+", text.lower()) if t]
    return {v: toks.count(v) for v in vocab}


def _loss(theta, rows, vocab):
    tot = 0.0
    for text, y in rows:
        c = _counts(text, vocab)
        z = theta[0] + sum(theta[1 + i] * c[v] for i, v in enumerate(vocab))
        p = 1 / (1 + math.exp(-z))
        tot += -y * math.log(p + 1e-15) - (1 - y) * math.log(1 - p + 1e-15)
    return tot / len(rows)


def test_loss_gradient_matches_finite_differences(spark):
    vocab = ["stupid", "idiot", "trash"]
    w = lexicon_model(spark, (0.7,), bias=-0.5, terms=tuple(vocab))
    d = _docs(spark)
    got = {r.term: r.grad for r in loss_gradient(d, w).collect()}
    rows = [(t, int(i % 3 == 0)) for i, t in enumerate(TEXTS)]
    theta = [-0.5] + [0.7] * len(vocab)
    for j, name in enumerate([None] + vocab):
        e = 1e-6
        tp, tm = list(theta), list(theta)
        tp[j] += e
        tm[j] -= e
        num = (_loss(tp, rows, vocab) - _loss(tm, rows, vocab)) / (2 * e)
        assert got.get(name, 0.0) == pytest.approx(num, abs=1e-7)


def _mean_var(theta, groups, vocab):
    vs = []
    for members in groups.values():
        if len(members) < 2:
            continue
        ps = []
        for text in members:
            c = _counts(text, vocab)
            z = theta[0] + sum(theta[1 + i] * c[v] for i, v in enumerate(vocab))
            ps.append(1 / (1 + math.exp(-z)))
        m = sum(ps) / len(ps)
        vs.append(sum((p - m) ** 2 for p in ps) / (len(ps) - 1))
    return sum(vs) / len(vs)


def test_variance_gradient_matches_finite_differences(spark):
    vocab = ["stupid", "idiot", "trash", "loser"]
    rnd = random.Random(5)
    groups = {}
    rows = []
    for gid in range(6):
        k = rnd.randint(1, 5)
        for pos in range(k):
            t = rnd.choice(TEXTS)
            groups.setdefault(gid, []).append(t)
            rows.append((gid, pos, t))
    df = spark.createDataFrame(rows, "group_id long, pos long, text string")
    w = lexicon_model(spark, (0.4,), bias=-0.3, terms=tuple(vocab))
    got = {r.term: r.grad for r in variance_gradient(df, w).collect()}
    theta = [-0.3] + [0.4] * len(vocab)
    for j, name in enumerate([None] + vocab):
        e = 1e-6
        tp, tm = list(theta), list(theta)
        tp[j] += e
        tm[j] -= e
        num = (_mean_var(tp, groups, vocab) - _mean_var(tm, groups, vocab)) / (2 * e)
        assert got.get(name, 0.0) == pytest.approx(num, abs=1e-8)


def test_null_text_scores_as_bias(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "idiot", 1)], "doc_id long, text string, label int")
    w = lexicon_model(spark)
    for strategy in ("inline", "join"):
        got = {(r.doc_id, r.candidate_id): r.logit for r in score_terms(d, w, key_cols=["doc_id"], strategy=strategy).collect()}
        assert got[(1, 0)] == -2.0 and got[(1, 1)] == -2.0 and got[(2, 1)] == 0.0
