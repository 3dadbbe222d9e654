"""Incremental pooling of experiment cells with Structured Streaming.

Cells land one (frac_id, trial_i) directory at a time while a grid runs. A
file-source stream over the cell folder

* appends every new cell to the pooled table (parquet file sink: exactly
  once, progress kept in the checkpoint), and
* keeps the per-fraction solution rate current (streaming aggregation in
  complete mode, each micro-batch overwriting a small report table).

Both queries restart from their checkpoints after a failure; the state of
the report is one row per fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.results import RESULT_SCHEMA, decode_gvec


def cell_stream(spark: SparkSession, cells_dir: str, fmt: str = "csv", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of result cells (partition columns frac_id, trial_i)."""
    reader = spark.readStream.schema(RESULT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.option("header", True).csv(cells_dir) if fmt == "csv" else reader.parquet(cells_dir)
    return df.withColumn("gvec", decode_gvec(F.col("gvec")))


def start_pooling(spark: SparkSession, cells_dir: str, pooled_path: str, checkpoint: str, available_now: bool = True, fmt: str = "csv") -> StreamingQuery:
    """Append new cells to the pooled parquet table."""
    w = cell_stream(spark, cells_dir, fmt).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(pooled_path)


def rate_report(cells: DataFrame) -> DataFrame:
    """Solution rate per fraction (works on a stream or a table)."""
    r = F.avg(F.col("passed_safety").cast("double"))
    n = F.count(F.lit(1))
    return cells.groupBy("frac_id", "data_frac").agg(
        n.alias("n_trials"), r.alias("solution_rate"), F.sqrt(r * (F.lit(1.0) - r) / n).alias("se_solution_rate")
    )


def start_rate_report(spark: SparkSession, cells_dir: str, report_path: str, checkpoint: str, available_now: bool = True, fmt: str = "csv") -> StreamingQuery:
    """Keep the per-fraction solution rate current in a small table."""

    def publish(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(report_path)

    w = (
        rate_report(cell_stream(spark, cells_dir, fmt))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
