"""Experiment result sources and sinks (SRC4, SRC5, SNK1-SNK3).

* per-cell results are written partitioned by (frac_id, trial_i): one output
  unit per cell, re-runnable per cell, readable back with partition pruning;
* trial files named ``data_frac_<f:.4f>_trial_<i>.csv`` (one row each) are read
  with the cell key parsed from the file name;
* ``gvec`` travels as text ``[v1,v2,...]`` (``-inf`` for no solution) and is
  decoded to ``ARRAY<DOUBLE>``; malformed numbers become NULL, not errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIAL_FILE_SCHEMA = T.StructType(
    [
        T.StructField("data_frac", T.DoubleType(), True),
        T.StructField("trial_i", T.IntegerType(), True),
        T.StructField("performance", T.DoubleType(), True),
        T.StructField("passed_safety", T.BooleanType(), True),
        T.StructField("gvec", T.StringType(), True),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("data_frac", T.DoubleType(), True),
        T.StructField("candidate_id", T.IntegerType(), True),
        T.StructField("performance", T.DoubleType(), True),
        T.StructField("passed_safety", T.BooleanType(), True),
        T.StructField("gvec", T.StringType(), True),
        T.StructField("frac_id", T.IntegerType(), True),
        T.StructField("trial_i", T.IntegerType(), True),
    ]
)

# Fixed value: name pattern of one-row trial files.
TRIAL_FILE_PATTERN = r"data_frac_(\d\.\d{4})_trial_(\d+)\.csv"


def encode_gvec(arr: Column) -> Column:
    """``ARRAY<DOUBLE>`` -> ``'[v1,v2]'``; infinities as ``-inf`` / ``inf``."""
    as_text = F.transform(
        arr,
        lambda x: F.when(x == F.lit(float("-inf")), F.lit("-inf"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .otherwise(x.cast("string")),
    )
    return F.when(arr.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", as_text), F.lit("]")))


def decode_gvec(text: Column) -> Column:
    """``'[-0.04893315]'`` / ``'[-inf]'`` -> ``ARRAY<DOUBLE>``; empty -> NULL."""
    body = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    parts = F.split(body, r"[,\s]+")
    vals = F.transform(F.filter(parts, lambda s: s != F.lit("")), lambda s: s.try_cast("double"))
    return F.when(F.trim(text) != F.lit(""), vals)


def write_trials(results: DataFrame, path: str, mode: str = "overwrite", fmt: str = "csv") -> None:
    """One output unit per (frac_id, trial_i) cell. With dynamic partition
    overwrite a re-run replaces only the cells it produced."""
    out = results.withColumn("gvec", encode_gvec(F.col("gvec"))) if isinstance(results.schema["gvec"].dataType, T.ArrayType) else results
    writer = out.write.mode(mode).partitionBy("frac_id", "trial_i").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def read_trials(spark: SparkSession, path: str, layout: str = "partitioned", fmt: str = "csv") -> DataFrame:
    """Read per-cell results back, gvec decoded.

    ``partitioned``: the layout of :func:`write_trials` (cell keys from the
    directory names). ``named``: one-row files ``data_frac_<f>_trial_<i>.csv``
    whose key is parsed from the file name (``file_data_frac``,
    ``file_trial_i``); the 4-decimal name is only a label, join on
    round(data_frac, 10) or on frac_id. ``pooled``: files with the columns of
    the trial files, any number of rows each."""
    if layout == "partitioned":
        reader = spark.read.schema(RESULT_SCHEMA)
        df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
        return df.withColumn("gvec", decode_gvec(F.col("gvec")))
    if layout == "pooled":
        return spark.read.schema(TRIAL_FILE_SCHEMA).option("header", True).csv(path).withColumn("gvec", decode_gvec(F.col("gvec")))
    if layout == "named":
        df = spark.read.schema(TRIAL_FILE_SCHEMA).option("header", True).csv(path)
        name = F.col("_metadata.file_name")
        return df.select(
            "*",
            F.regexp_extract(name, TRIAL_FILE_PATTERN, 1).cast("double").alias("file_data_frac"),
            F.regexp_extract(name, TRIAL_FILE_PATTERN, 2).cast("int").alias("file_trial_i"),
        ).withColumn("gvec", decode_gvec(F.col("gvec")))
    raise ValueError(f"unknown layout {layout!r}")


def write_pooled(results: DataFrame, path: str) -> None:
    """All cells as CSV files with the columns of the trial files."""
    names = [f.name for f in TRIAL_FILE_SCHEMA.fields]
    results.withColumn("gvec", encode_gvec(F.col("gvec"))).select(*names).write.option("header", True).csv(path)


def pool_trials(cells: DataFrame | list[DataFrame]) -> DataFrame:
    """All cells in one table, ordered by (frac_id, trial_i)."""
    if isinstance(cells, list):
        out = cells[0]
        for c in cells[1:]:
            out = out.unionByName(c, allowMissingColumns=True)
        cells = out
    return cells.orderBy("frac_id", "trial_i")


def write_log(log: DataFrame, path: str) -> None:
    """Append training-iteration rows (one per step)."""
    log.write.mode("append").parquet(path)
