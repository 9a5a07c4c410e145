"""Keyed tables: parquet with a declared schema, or a typed empty stand-in where a source is missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_empty(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> tuple[DataFrame, bool]:
    """The table, and whether it was there; a missing one is an empty frame of ``schema``."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet"), True
    except AnalysisException:
        return spark.createDataFrame([], schema), False
