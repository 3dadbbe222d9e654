"""Mini-batch descent against a sequential run in plain Python."""

import hashlib
import math
import re
import statistics

import pytest
from conftest import SF_SMALL

from varguard.config import VPROB
from varguard.operators.minibatch import MiniBatchConfig, batch_rows, fit_minibatch
from varguard.operators.score import parameter_frame
from varguard.sources.standins import document_groups, primary_table

TERMS = ["trash", "idiot", "the", "of"]
CFG = MiniBatchConfig(alpha_theta=0.01, alpha_lambda=0.02, n_epochs=3, lambda_init=0.5)


def batches(keys, size, epoch, seed=42):
    """SP3: an epoch's permutation cut into batches."""
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:epoch:{epoch}:{k}".encode()).hexdigest(), k))
    return [order[i : i + size] for i in range(0, len(order), size)]


def words(text):
    return [w for w in re.split("[^a-z]+", (text or "").lower()) if w in TERMS]


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def walk(state, steps, cfg, k):
    """state: theta, m, v, lam, t; steps: (rows (label, words), groups (lists of words))."""
    theta, m, v, lam, t = list(state[0]), list(state[1]), list(state[2]), state[3], state[4]
    losses, gs = [], []
    score = lambda ws: sigmoid(theta[0] + sum(theta[1 + TERMS.index(w)] for w in ws))
    for rows, groups in steps:
        grad, loss = [0.0] * len(theta), 0.0
        for y, ws in rows:
            p, c = score(ws), 1e-15
            loss += (-y * math.log(p + c) - (1 - y) * math.log(1 - p + c)) / len(rows)
            r = (-y / (p + c) + (1 - y) / (1 - p + c)) * p * (1 - p) / len(rows)
            for i in [0, *(1 + TERMS.index(w) for w in ws)]:
                grad[i] += r
        losses.append(loss)
        if groups:
            ps = [[score(ws) for ws in g] for g in groups]
            var = [statistics.variance(p) for p in ps]
            mean, sd = statistics.mean(var), statistics.stdev(var) if len(var) > 1 else 0.0
            g_value = mean + (k * sd if k and sd > 0 else 0.0) - VPROB.threshold
            for g, p, x in zip(groups, ps, var, strict=True):
                share = 1 / len(groups) + (k * (x - mean) / (sd * (len(var) - 1)) if k and sd > 0 else 0.0)
                for ws, q in zip(g, p, strict=True):
                    d = lam * share * 2 / (len(p) - 1) * (q - statistics.mean(p)) * q * (1 - q)
                    for i in [0, *(1 + TERMS.index(w) for w in ws)]:
                        grad[i] += d
            gs.append(g_value)
        t += 1
        for i, x in enumerate(grad):
            m[i] = cfg.beta_velocity * m[i] + (1 - cfg.beta_velocity) * x
            v[i] = cfg.beta_rmsprop * v[i] + (1 - cfg.beta_rmsprop) * x * x
            theta[i] -= cfg.alpha_theta * m[i] / (1 - cfg.beta_velocity**t) / (math.sqrt(v[i] / (1 - cfg.beta_rmsprop**t)) + cfg.eps)
        if groups:
            lam = max(0.0, lam + cfg.alpha_lambda * gs[-1])
    return (theta, m, v, lam, t), losses, gs


def sequential(primary, groups, cfg, shards, k):
    labelled = {r["doc_id"]: (r["label"], words(r["text"])) for r in primary}
    by_group = {}
    for r in groups:
        by_group.setdefault(r["group_id"], []).append(words(r["text"]))
    by_group = {g: x for g, x in by_group.items() if len(x) >= 2}
    state, log = ([-2.0] + [1.0] * len(TERMS), [0.0] * 5, [0.0] * 5, cfg.lambda_init, 0), []
    for epoch in range(cfg.n_epochs):
        ps, gs = batches(labelled, cfg.primary_batch, epoch), batches(by_group, cfg.group_batch, epoch)
        ends = []
        for s in range(shards):
            mine, own = ps[s::shards], gs[s::shards]
            steps = [([labelled[i] for i in b], [by_group[g] for g in own[j % len(own)]] if own else []) for j, b in enumerate(mine)]
            ends.append((len(steps), *walk(state, steps, cfg, k)))
        n = sum(e[0] for e in ends)
        avg = lambda f: sum(e[0] * f(e[1]) for e in ends) / n
        state = (
            *[[avg(lambda x, c=c, i=i: x[c][i]) for i in range(5)] for c in range(3)], avg(lambda x: x[3]), state[4] + max(e[0] for e in ends),
        )
        seen = [g for e in ends for g in e[3]]
        log.append((epoch, n, sum(x for e in ends for x in e[2]) / n, sum(seen) / len(seen), state[3], state[0]))
    return log


@pytest.mark.parametrize("shards,n_safety", [(1, None), (1, 30), (3, 30)])
def test_mini_batches_equal_the_sequential_walk(spark, shards, n_safety):
    from varguard.functions.stats import t_ppf

    primary, groups = primary_table(spark, SF_SMALL), document_groups(spark, SF_SMALL, ("lang", "source"))
    theta, bias, log = fit_minibatch(primary, groups, dict.fromkeys(TERMS, 1.0), -2.0, CFG, VPROB, n_safety, shards)
    k = 2 * t_ppf(0.95, n_safety - 1) / math.sqrt(n_safety) if n_safety else None
    global_terms = sorted(TERMS)
    want = sequential(primary.collect(), groups.collect(), CFG, shards, k)
    assert len(log) == len(want) == 3
    for got, exp in zip(log, want, strict=True):
        assert got[:2] == exp[:2] and all(abs(a - b) < 1e-9 for a, b in zip(got[2:5], exp[2:5], strict=True))
        weights = dict(got[5])
        assert abs(weights[None] - exp[5][0]) < 1e-9
        assert all(abs(weights[w] - exp[5][1 + TERMS.index(w)]) < 1e-9 for w in global_terms)
    assert abs(theta["the"] - 1.0) > 0.01 and abs(bias + 2) > 0.01  # it really moves


def test_mini_batches_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "trash of", 1), (2, None, 0), (3, "the", None)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "group_id long, text string")
    theta, _, log = fit_minibatch(rows, none, dict.fromkeys(TERMS, 1.0), -2.0, CFG)
    assert [r[1] for r in log] == [1, 1, 1] and all(r[3] is None for r in log) and theta["trash"] > 1.0
    one = spark.createDataFrame([(1, "the"), (2, "of"), (2, "the the")], "group_id long, text string")  # a group of one member
    assert fit_minibatch(rows, one, dict.fromkeys(TERMS, 1.0), -2.0, CFG)[2][0][3] is not None
    theta, bias, log = fit_minibatch(rows.limit(0), one, {"the": 1.0}, -2.0, CFG)
    assert (theta, bias, log) == ({"the": 1.0}, -2.0, [])


def test_an_epoch_is_a_job_whatever_its_batches(spark):
    """Twice the batches are the same number of jobs."""
    sc = spark.sparkContext
    seen = []
    for times in (1, 4):
        rows = spark.range(60 * times).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'the of', 'trash') AS text", "CAST(id % 2 AS INT) AS label")
        groups = spark.range(40 * times).selectExpr("id % 8 AS group_id", "IF(id % 3 = 0, 'the', 'of') AS text")
        sc.setJobGroup(f"mini-{times}", "")
        fit_minibatch(rows, groups, {"the": 1.0, "of": 0.5, "trash": 0.1}, 0.0, CFG)
        seen.append(len(sc.statusTracker().getJobIdsForGroup(f"mini-{times}")))
    sc.setJobGroup("", "")
    assert seen[0] == seen[1]


def test_group_rows_are_sent_once_an_epoch(spark):
    """Ten times the steps send no more rows of groups, however often a batch of groups comes round."""
    model = parameter_frame(spark, [(0, None, 0.0), (0, "the", 1.0), (0, "of", 0.5)])
    groups = spark.range(60).selectExpr("id % 12 AS group_id", "repeat('the ', CAST(id AS INT)) AS text")
    for n in (60, 600):
        rows = spark.range(n).selectExpr("id AS doc_id", "'the of' AS text", "CAST(id % 2 AS INT) AS label")
        sent, shards = batch_rows(rows, groups, model, CFG, 2, "doc_id", "group_id")
        assert shards == 2 and sent.where("kind = 1").count() == 60 * CFG.n_epochs
        assert sent.where("kind = 0").count() == n * CFG.n_epochs
