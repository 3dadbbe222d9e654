"""Labelled-text and text-group sources (SRC1-SRC3).

Schemas are declared, never inferred. The labelled table keeps the declared
column names, including ``acl.id`` (a dot in the name: always back-quoted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PRIMARY_COLUMNS
from ..operators.prep import derive_split

LABELLED_SCHEMA = T.StructType(
    [
        T.StructField("acl.id", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("label", T.IntegerType(), True),
        T.StructField("split", T.StringType(), True),
    ]
)

GROUPS_SCHEMA = T.StructType(
    [
        T.StructField("group_id", T.LongType(), False),
        T.StructField("text_groups", T.ArrayType(T.StringType(), True), True),
    ]
)

METADATA = {"all_col_names": list(PRIMARY_COLUMNS), "sensitive_col_names": []}


def read_labelled_text(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Labelled text with header; quoted text may hold commas, quotes and
    newlines. Malformed rows fail the read instead of being dropped.

    A multi-line CSV file is read by one task; large inputs should come as
    many files (or parquet, which splits)."""
    reader = spark.read.schema(LABELLED_SCHEMA)
    if fmt == "csv":
        return reader.options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST").csv(path)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unsupported format {fmt!r}")


def write_labelled_text(df: DataFrame, path: str) -> None:
    """The CSV files that :func:`read_labelled_text` reads back unchanged:
    quotes doubled, outer blanks and newlines kept, NULL apart from the empty text."""
    df.select(*[F.col(f"`{c}`") for c in PRIMARY_COLUMNS]).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_metadata(spark: SparkSession, path: str, meta: dict = METADATA) -> None:
    schema = "all_col_names array<string>, sensitive_col_names array<string>"
    spark.createDataFrame([(list(meta["all_col_names"]), list(meta.get("sensitive_col_names") or []))], schema).coalesce(1).write.json(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """Column-name metadata document ``{all_col_names, sensitive_col_names}``."""
    row = spark.read.option("multiLine", True).json(path).first()
    return {
        "all_col_names": list(row["all_col_names"] or []),
        "sensitive_col_names": list(row["sensitive_col_names"] or []) if "sensitive_col_names" in row else [],
    }


def apply_metadata(df: DataFrame, meta: dict = METADATA) -> DataFrame:
    """Keep the declared columns in declared order; fail if one is missing;
    flag sensitive columns in the field metadata."""
    names = list(meta["all_col_names"])
    sensitive = set(meta.get("sensitive_col_names") or [])
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"declared columns missing from input: {missing}")
    unknown = sensitive - set(names)
    if unknown:
        raise ValueError(f"sensitive columns not declared: {sorted(unknown)}")
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"sensitive": c in sensitive}) for c in names])


def sensitive_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get("sensitive")]


def labelled_from_primary(primary: DataFrame) -> DataFrame:
    """The declared labelled-text shape from a ``(doc_id, text, label)`` table;
    ``split`` is derived from a hash of the id."""
    return primary.select(
        F.col("doc_id").cast("string").alias("acl.id"),
        "text",
        F.col("label").cast("int").alias("label"),
        derive_split(F.col("doc_id")).alias("split"),
    )


def read_text_groups(spark: SparkSession, path: str, fmt: str = "parquet", positional: bool = False) -> DataFrame:
    """One row per group: ``(group_id BIGINT, text_groups ARRAY<STRING>)``.

    ``positional``: the files hold arrays without ids; a group gets a unique
    number that rises with its place in the files (not dense)."""
    schema = T.StructType([f for f in GROUPS_SCHEMA.fields if not (positional and f.name == "group_id")])
    reader = spark.read.schema(schema)
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    groups = reader.parquet(path) if fmt == "parquet" else reader.json(path)
    return groups.select(F.monotonically_increasing_id().alias("group_id"), "text_groups") if positional else groups
