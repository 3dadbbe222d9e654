"""Configuration and fixed values.

Everything that must equal the studied job's settings for comparable results
is listed here, as plain values, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay as written)
# ---------------------------------------------------------------------------
# Stability constant added inside both logarithms of the log loss.
STABILITY_CONST = 1e-15
# Behavioural constraint: mean within-group variance of the predicted
# probability must be at most 0.05, with confidence 1 - 0.05.
VPROB_THRESHOLD = 0.05
DELTA = 0.05
# Share of the data held back for the safety test.
FRAC_DATA_IN_SAFETY = 0.6
# Seed of the shuffle and of every hash-based draw.
SEED = 42
# Batch sizes: primary rows, text groups, safety groups; epochs of descent.
PRIMARY_BATCH_SIZE = 12
GROUP_BATCH_SIZE = 5
SAFETY_BATCH_SIZE = 8
N_EPOCHS = 3
# Constrained-descent hyper-parameters.
LAMBDA_INIT = 0.05
ALPHA_THETA = 0.00001
ALPHA_LAMBDA = 0.00005
BETA_VELOCITY = 0.9
BETA_RMSPROP = 0.95
# Experiment grid: 10 trials, 10 data fractions spaced evenly in log10 from
# -2.5 to 0.
N_TRIALS = 10
FRAC_LOG10_LO = -2.5
FRAC_LOG10_HI = 0.0
N_FRACS = 10
# Declared columns of the labelled-text table and of the text-group table.
PRIMARY_COLUMNS = ["acl.id", "text", "label", "split"]
GROUP_COLUMNS = ["text_groups"]
# Test-data stand-in scorer: bias -2 plus one weight per listed term.
LEXICON = [
    "trash", "idiot", "scum", "clown", "worthless",
    "moron", "pathetic", "loser", "stupid", "disgusting",
]
LEXICON_BIAS = -2.0
CANDIDATE_WEIGHTS = [1.0, 2.0]
EXPERIMENT_CANDIDATE_WEIGHTS = [0.5, 1.0, 1.5, 2.0]
# Pronouns swapped to build counterfactual sentence groups.
PRONOUN_SLOT = "he"
PRONOUN_TERMS = ["he", "she", "they"]
# ---------------------------------------------------------------------------


def frac_grid_values(lo: float = FRAC_LOG10_LO, hi: float = FRAC_LOG10_HI, k: int = N_FRACS) -> list[float]:
    """Data fractions 10**(lo + i*(hi-lo)/(k-1)), i = 0..k-1 (numpy logspace)."""
    if k == 1:
        return [10.0 ** hi]
    step = (hi - lo) / (k - 1)
    return [10.0 ** (lo + i * step) for i in range(k)]


@dataclass(frozen=True)
class Constraint:
    """``measure op threshold`` with confidence ``1 - delta``.

    ``g = measure - threshold`` for ``<=`` and ``threshold - measure`` for
    ``>=``; the model is safe when the high-confidence bound of g is <= 0.
    """

    name: str
    measure: str
    op: str = "<="
    threshold: float = VPROB_THRESHOLD
    delta: float = DELTA

    def __post_init__(self):
        if self.op not in ("<=", ">="):
            raise ValueError(f"unsupported comparison {self.op!r}")
        if not 0.0 < self.delta < 1.0:
            raise ValueError("delta must lie in (0, 1)")

    @property
    def sign(self) -> float:
        return 1.0 if self.op == "<=" else -1.0


VPROB = Constraint("VPROB <= 0.05", "VPROB", "<=", VPROB_THRESHOLD, DELTA)


@dataclass(frozen=True)
class ExperimentConfig:
    n_trials: int = N_TRIALS
    fracs: tuple = field(default_factory=lambda: tuple(frac_grid_values()))
    frac_safety: float = FRAC_DATA_IN_SAFETY
    constraint: Constraint = VPROB
    seed: int = SEED
    min_units: int = 2
    #: A list of constraints, each with its own delta, in place of ``constraint``.
    constraints: tuple = ()
    #: Metric that candidates are chosen by, and the one that results report (``operators.measures.register_metric``).
    objective: str = "log_loss"
    performance: str = "log_loss"
    #: For each constraint the measure that its true g is evaluated with (None or missing: its own).
    evaluations: tuple = ()

    def __post_init__(self):
        if len(self.evaluations) > len(self.all_constraints):
            raise ValueError("more evaluations than constraints")

    @property
    def all_constraints(self) -> tuple:
        return tuple(self.constraints) or (self.constraint,)

    @property
    def evaluation_measures(self) -> list:
        """The measure that each constraint's true g is evaluated with."""
        given = list(self.evaluations) + [None] * (len(self.all_constraints) - len(self.evaluations))
        return [e or c.measure for e, c in zip(given, self.all_constraints, strict=True)]

    @property
    def measures(self) -> list:
        """Every group measure that the experiment needs, once."""
        return list(dict.fromkeys([c.measure for c in self.all_constraints] + self.evaluation_measures))
