"""The README usage example, end to end from raw files."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from varguard.config import Constraint
from varguard.operators.nested import flatten_groups
from varguard.operators.score import lexicon_model
from varguard.plans.safety import safety_report
from varguard.sources.standins import conversation_groups, primary_table
from varguard.sources.text import labelled_from_primary, read_labelled_text, read_text_groups
from varguard.operators.nested import nest_texts


def test_readme_usage(spark, tmp_path):
    # inputs in the studied job's shapes: labelled CSV, group arrays, weights table
    labelled_path, groups_path, weights_path = str(tmp_path / "l"), str(tmp_path / "g"), str(tmp_path / "w")
    labelled_from_primary(primary_table(spark, SF_SMALL)).write.option("header", True).option("escape", '"').csv(labelled_path)
    nest_texts(conversation_groups(spark, SF_SMALL)).select("group_id", "text_groups").write.json(groups_path)
    lexicon_model(spark).write.parquet(weights_path)

    # --- README example ---
    labelled = read_labelled_text(spark, labelled_path)
    primary = labelled.filter(F.col("split") == "train").select(F.col("`acl.id`").alias("doc_id"), "text", "label")
    groups = flatten_groups(read_text_groups(spark, groups_path, "json"))
    weights = spark.read.parquet(weights_path)
    report = safety_report(primary, groups, weights, Constraint("VPROB <= 0.05", "VPROB", "<=", 0.05, 0.05))
    # ----------------------
    rows = report.collect()
    assert len(rows) == 2 and all(r.n_groups > 0 and r.n_rows > 0 for r in rows)
