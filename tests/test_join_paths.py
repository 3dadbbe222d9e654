"""Both join orders of the labelled text give the same answers."""

from conftest import SF_SMALL

import varguard.sources.standins as S
from varguard.operators.score import lexicon_model, score_terms
from varguard.plans.safety import corpus_safety_report
from varguard.session import load_table


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_labelled_logits_both_orders(spark, monkeypatch):
    w = lexicon_model(spark)
    small, _ = S.labelled_logits(spark, SF_SMALL, w)
    monkeypatch.setattr(S, "LABELS_BROADCAST_MAX_ROWS", 0)
    big, _ = S.labelled_logits(spark, SF_SMALL, w)
    assert _rows(small) == _rows(big)
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("Join")[0]  # texts are scored before the join, not carried through it


def test_corpus_report_both_orders(spark):
    w = lexicon_model(spark)
    docs = load_table(spark, SF_SMALL, "documents")
    labels, _ = S.labels_table(spark, SF_SMALL)
    a = corpus_safety_report(docs, labels, ("lang", "source"), w, labels_broadcast=True)
    b = corpus_safety_report(docs, labels, ("lang", "source"), w, labels_broadcast=False)
    assert _rows(a) == _rows(b)


def test_gradients_beyond_the_inline_bound(spark, monkeypatch):
    """Joined and inlined models have the same gradients, on repeated, null and
    unknown texts, with a candidate that has no bias of its own."""
    from varguard.operators import score
    from varguard.operators.train import loss_gradient, variance_gradient

    rows = [(1, 0, "he is bad"), (1, 0, "he is bad"), (1, 1, None), (2, 1, "bad bad he"), (2, 0, ""), (2, 1, "nothing known")]
    df = spark.createDataFrame(rows, "group_id long, label int, text string")
    params = [(0, None, -1.0), (0, "he", 0.5), (0, "bad", 1.0), (1, "bad", -2.0), (1, "he", 0.25)]
    w = spark.createDataFrame(params, "candidate_id int, term string, weight double")
    both = []
    for bound in (score.INLINE_MAX, 0):
        monkeypatch.setattr(score, "INLINE_MAX", bound)
        got = {}
        for name, g in (("loss", loss_gradient(df, w)), ("variance", variance_gradient(df, w))):
            got.update({(name, r.candidate_id, r.term): round(r.grad, 9) for r in g.collect()})
        logits = score.score_terms(df, w)
        got["logits"] = sorted((r.group_id, r.label, r.candidate_id, round(r.logit, 9)) for r in logits.collect())
        both.append(got)
    assert both[0] == both[1] and len(both[0]) == 13 and len(both[0]["logits"]) == 12


def test_unknown_words_never_cross_a_shuffle(spark):
    """A text of many words that no model knows sends the bias and its known words only."""
    docs = spark.range(20).selectExpr("id", "concat('trash trash ', array_join(transform(sequence(1, 2000), i -> concat('word', translate(i, '0123456789', 'abcdefghij'))), ' ')) AS text")
    scored = score_terms(docs, lexicon_model(spark, (1.0, 2.0)), strategy="join", keep_hits=True)
    got = scored.collect()
    assert {(r.id, r.candidate_id, r.logit, tuple(r.hits)) for r in got} == {(i, c, 2.0 * c, ("trash", "trash")) for i in range(20) for c in (0, 1)}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    semi, counted = plan.index("LeftSemi"), plan.rindex("Aggregate [_kept")
    assert counted < semi  # below the first aggregation, so before its shuffle


def test_shuffled_parameters_score_like_broadcast_ones(spark, monkeypatch):
    from varguard.operators import score

    docs = spark.createDataFrame([(1, "trash of trash idiot"), (1, "trash of trash idiot"), (2, None), (3, "nothing")], "id long, text string")
    both = []
    for bound in (score.BROADCAST_MAX_ROWS, 0):
        monkeypatch.setattr(score, "BROADCAST_MAX_ROWS", bound)
        scored = score_terms(docs, lexicon_model(spark, (1.0, 2.0)), strategy="join", keep_hits=True).collect()
        both.append(sorted((r.id, r.candidate_id, r.logit, sorted(r.hits)) for r in scored))
    assert both[0] == both[1] and len(both[0]) == 8 and both[0][0] == (1, 0, 1.0, ["idiot", "trash", "trash"])
