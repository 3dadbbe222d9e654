from varguard.config import Constraint
from varguard.operators.train import DescentConfig, best_iterate, fit_constrained, LOG_SCHEMA

TEXTS = ["stupid idiot", "lovely day", "trash", "idiot", "fine", "ok", "stupid", "nice", "idiot trash", "calm"]


def _data(spark):
    primary = spark.createDataFrame([(i, t, int("idiot" in t or "trash" in t)) for i, t in enumerate(TEXTS)],
                                    "doc_id long, text string, label int")
    groups = spark.createDataFrame([(g, i, TEXTS[(g + i) % len(TEXTS)]) for g in range(6) for i in range(3)],
                                   "group_id long, pos long, text string")
    return primary, groups


def test_descent_log_and_progress(spark):
    primary, groups = _data(spark)
    cfg = DescentConfig(alpha_theta=0.2, n_epochs=3)
    loose = Constraint("VPROB <= 0.5", "VPROB", "<=", 0.5, 0.05)
    theta, bias, log = fit_constrained(primary, groups, {"idiot": 0.0, "trash": 0.0, "stupid": 0.0}, 0.0, cfg, loose)
    assert len(log) == 3  # a step over all rows and groups for each epoch
    assert all(r[3] >= 0.0 for r in log)  # lambda never negative
    assert theta["idiot"] > 0.0 and theta["trash"] > 0.0  # labelled toxic terms gain weight
    first, last = log[0][1], log[-1][1]
    assert last < first
    best = best_iterate(spark.createDataFrame(log, LOG_SCHEMA)).first()
    assert best.solution_found and best.loss == min(r[1] for r in log if r[2] is not None and r[2] <= 0)
    assert best.theta == next(r[4] for r in log if r[0] == best.step) and len(best.theta) == 4


def test_binding_constraint_raises_lambda(spark):
    primary, groups = _data(spark)
    tight = Constraint("VPROB <= 0", "VPROB", "<=", 0.0, 0.05)
    _, _, log = fit_constrained(primary, groups, {"idiot": 3.0, "trash": 3.0}, -1.0, DescentConfig(alpha_lambda=1.0, n_epochs=2), tight)
    assert log[-1][3] > log[0][3]
    assert fit_constrained(primary.limit(0), groups.limit(0), {"idiot": 1.0}, 0.5)[1:] == (0.5, [])


def test_bound_gradient_matches_finite_differences(spark):
    import math
    import statistics

    from pyspark.sql import functions as F

    from varguard.operators.score import parameter_frame, score_terms
    from varguard.operators.train import _group_step

    vocab = ["idiot", "trash", "stupid"]
    members = [(g, " ".join(TEXTS[(g * 3 + i) % len(TEXTS)] for _ in range(1 + (i % 2)))) for g in range(5) for i in range(3)]
    gb0 = spark.createDataFrame(members, "group_id long, text string")
    k = 2 * 1.8 / math.sqrt(30)
    theta = {None: -0.4, "idiot": 0.8, "trash": 0.3, "stupid": -0.2}

    def target(th):
        vs = []
        for g in range(5):
            ps = []
            for gg, text in members:
                if gg != g:
                    continue
                toks = [t for t in text.lower().split() if t in vocab]
                z = th[None] + sum(th[t] for t in toks)
                ps.append(1 / (1 + math.exp(-z)))
            vs.append(statistics.variance(ps))
        return statistics.fmean(vs) + k * statistics.stdev(vs)

    def spark_grad(th):
        w = parameter_frame(spark, [(0, t, x) for t, x in th.items()])
        rows = _group_step(score_terms(gb0, w, keep_hits=True), 1.0, k).collect()
        return {r.term: r.s for r in rows}, next(r.loss_sum for r in rows if r.term is None)

    got, value = spark_grad(theta)
    assert abs(value - target(theta)) < 1e-12
    for name in [None] + vocab:
        e = 1e-6
        tp, tm = dict(theta), dict(theta)
        tp[name] += e
        tm[name] -= e
        num = (target(tp) - target(tm)) / (2 * e)
        assert abs(got.get(name, 0.0) - num) < 1e-7
