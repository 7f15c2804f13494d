"""Parquet and CSV tables: embeddings, results and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as fx


class SchemaError(ValueError):
    """A stored table lacks a column that its readers rely on."""


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, grp, label, features, path); the group comes from the path."""
    rows = require(spark.read.parquet(path), schemas.EMBEDDING_COLUMNS)
    return rows.select(
        F.col("path").alias("row_id"), fx.group_key("path").alias("grp"), "label", "features", "path"
    )


def read_results(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Per-arm result rows; ``selected`` is an array again."""
    reader = spark.read.schema(schemas.RESULT)
    rows = reader.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    if dict(rows.dtypes)["selected"] == "string":
        rows = rows.withColumn("selected", fx.split_indices("selected"))
    return rows


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A stored split with its ``transform_fit`` declaration; a missing column is refused."""
    return require(spark.read.parquet(path), (*schemas.SPLIT_COLUMNS, "transform_fit"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a scan that has fewer splits than there are cores, for row-heavy work after it.

    On a large table the scan has more splits than cores and nothing is moved.
    Only for plans without a shuffle of their own.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
