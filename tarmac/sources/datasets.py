"""Labelled data sets: load, inspect, write as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_dataset(
    spark: SparkSession,
    path: str,
    view: str,
    file_format: str = "json",
    schema: StructType | str | None = None,
    cache: bool = True,
) -> DataFrame:
    """Read a stored data set and register it as temporary view `view`.

    JSON without a schema is inferred from every document, which reads the data
    twice; give a schema where it is known. `cache` keeps the rows for the several
    actions of a training run; leave it off for a single pass.
    """
    if not path:
        raise ValueError("path of the data set is not set")
    if not view:
        raise ValueError("name of the view is not set")
    reader = spark.read.format(file_format)
    if schema is not None:
        reader = reader.schema(schema)
    elif file_format == "json":
        reader = reader.option("samplingRatio", 1.0)
    df = reader.load(path)
    if cache:
        df = df.cache()
    df.createOrReplaceTempView(view)
    return df


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows and values. One pass, no shuffle of rows."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("column_type"),
            F.col("_rows").alias("rows"),
            F.col(f"_{i}").alias("non_null"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per row, missing fields left out."""
    df.write.mode(mode).json(path)
