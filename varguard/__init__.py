"""varguard: behavioural-constraint testing of text classifiers on Spark.

Main entry points (all take and return DataFrames):

* scoring: ``operators.score.score_terms`` / ``score_arrays`` / ``score_with``
* measures: ``operators.measures.cross_entropy``, ``vprob``, ``summarise``
* constraints: ``config.Constraint``, ``operators.constraints.constraint_bounds``,
  ``safety_test``, ``predicted_bound``
* selection and training: ``operators.train.select_candidate``, ``loss_gradient``,
  ``variance_gradient``, ``fit_constrained``
* experiment: ``plans.experiment.run_experiment`` / ``corpus_unit_values`` +
  ``results_from_units`` and the reports ``learning_curve``, ``solution_rate``,
  ``failure_rate``
* one-shot report: ``plans.safety.safety_report`` / ``corpus_safety_report``
"""

from .config import Constraint, ExperimentConfig  # noqa: F401

__version__ = "0.1.0"
