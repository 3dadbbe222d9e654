"""The experiment's weighted moments equal statistics over explicit resampled
copies, recomputed here in plain Python from the same per-unit hashes."""

import hashlib
import math
import statistics

import pytest

from conftest import SF_SMALL
from varguard.config import ExperimentConfig
from varguard.operators.resample import poisson_cdf
from varguard.operators.score import lexicon_model
from varguard.plans.experiment import corpus_unit_values, experiment_moments
from varguard.session import load_table
from varguard.sources.standins import labels_table


def _u(h, slot):
    return int(h[8 * slot: 8 * slot + 8], 16) / 4294967296.0


def _draw(cfg, trial, kind, unit):
    h = hashlib.md5(f"{cfg.seed}:trial:{trial}:{kind}:{unit}".encode()).hexdigest()
    part = "safety" if _u(h, 0) < cfg.frac_safety else "candidate"
    cdf = poisson_cdf()
    u1 = _u(h, 1)
    w = next((k for k, c in enumerate(cdf) if u1 < c), len(cdf))
    u2 = _u(h, 2)
    frac = next((k for k, f in enumerate(cfg.fracs) if u2 < f), len(cfg.fracs) - 1)
    return part, w, frac


def test_moments_equal_explicit_copies(spark):
    cfg = ExperimentConfig(n_trials=3)
    w = lexicon_model(spark, (1.0, 2.0))
    labels, small = labels_table(spark, SF_SMALL)
    units, cands = corpus_unit_values(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), w, small)
    unit_rows = units.collect()
    mom = {(r.trial_i, r.kind, r.part, r.frac_id, r.cand_idx): r for r in experiment_moments(units, cfg, len(cands)).collect()}
    checked = 0
    for trial in range(cfg.n_trials):
        for frac in range(len(cfg.fracs)):
            for kind in ("p", "g"):
                for part in ("candidate", "safety"):
                    for c in range(len(cands)):
                        copies, distinct = [], 0
                        for r in unit_rows:
                            if r.kind != kind or r.xs[c] is None:
                                continue
                            p_, w_, f_ = _draw(cfg, trial, kind, r.unit)
                            if p_ == part and f_ <= frac and w_ > 0:
                                copies += [r.xs[c]] * w_
                                distinct += 1
                        cum = [m for (t, k, pt, f, ci), m in mom.items() if (t, k, pt, ci) == (trial, kind, part, c) and f <= frac]
                        sw = sum(m.sw for m in cum)
                        assert sw == len(copies)
                        assert sum(m.nu for m in cum) == distinct
                        if len(copies) >= 2:
                            s1, s2 = sum(m.swx for m in cum), sum(m.swx2 for m in cum)
                            mean = s1 / sw
                            sd = math.sqrt(max((s2 - s1 * s1 / sw) / (sw - 1), 0.0))
                            assert mean == pytest.approx(statistics.fmean(copies), rel=1e-9, abs=1e-12)
                            # equal values leave the rounding of s2, whose root is 2**-26 of the value
                            assert sd == pytest.approx(statistics.stdev(copies), rel=1e-6, abs=2**-26 * max(map(abs, copies)))
                            checked += 1
    assert checked > 20


def test_resume_writes_each_cell_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from varguard.plans.experiment import resume_experiment, results_from_units
    from varguard.sources.results import read_trials, write_trials

    cfg = ExperimentConfig(n_trials=3)
    w = lexicon_model(spark, (1.0, 2.0))
    labels, small = labels_table(spark, SF_SMALL)
    units, cands = corpus_unit_values(load_table(spark, SF_SMALL, "documents"), labels, ("lang", "source"), w, small)
    full = results_from_units(units, cands, cfg)
    cells = str(tmp_path / "cells")
    write_trials(full.filter(F.col("trial_i") == 0), cells)  # an interrupted run: one trial recorded
    assert resume_experiment(units, cands, cells, cfg) == 2 * len(cfg.fracs)
    assert resume_experiment(units, cands, cells, cfg) == 0  # nothing left to do
    got = read_trials(spark, cells)
    assert got.count() == 3 * len(cfg.fracs)
    key = lambda r: (r.frac_id, r.trial_i)
    want = {key(r): (r.passed_safety, r.gvec, r.performance) for r in full.collect()}
    assert {key(r): (r.passed_safety, r.gvec, r.performance) for r in got.collect()} == want
