"""Sinks: tables with provenance, sorted indexes, manifests, registries, rejects and GeoJSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _put(df: DataFrame, path: str, text: str) -> None:
    """A small text file through Hadoop's file system, so any scheme works."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_csv(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """A CSV directory with a ``_source.json`` beside its parts that says where its rows are from."""
    df.write.mode("overwrite").csv(path, header=True)
    _put(df, f"{path}/_source.json", json.dumps(provenance | {"columns": df.columns}, sort_keys=True))


def write_index(df: DataFrame, path: str, cell: str, parent: Column, partitions: int | None = None, block_bytes: int = 1 << 20) -> None:
    """Parquet sorted by cell with its coarse parent as column ``p``: row groups are small and ranges of cells disjoint,
    so a filter on ``p`` or ``cell`` skips all but a few."""
    ranged = df.withColumn("p", parent)
    ranged = ranged.repartitionByRange(partitions, cell) if partitions else ranged.repartitionByRange(cell)
    ranged.sortWithinPartitions(cell).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(block_bytes)).parquet(path)


def table_manifest(df: DataFrame, name: str) -> DataFrame:
    """``table_name, column, type, n_rows, n_known, n_distinct`` of each column, in one pass."""
    texts = {c: F.col(c).cast("string") for c in df.columns}
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(df.columns)], *[F.count_distinct(texts[c]).alias(f"d{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("n_rows"), F.col(f"k{i}").alias("n_known"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(df.columns)])
    return wide.select(F.inline(rows))


def append_new(registry: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key the registry doesn't have, one per key (the least row): appending them twice adds nothing."""
    rest = [c for c in incoming.columns if c != key]
    fresh = incoming.where(F.col(key).isNotNull()).join(registry.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the others with ``_reason``: the first rule they break (a null result breaks a rule)."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    marked = df.withColumn("_reason", reason)
    return marked.where(F.col("_reason").isNull()).drop("_reason"), marked.where(F.col("_reason").isNotNull())


def feature_json(geometry_type: str, coordinates: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text, nulls kept."""
    geometry = F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def compact_points(lat: Column, lon: Column, flags: Column, digits: int = 4) -> Column:
    """``[lon,lat,flags]`` as text."""
    return F.concat(F.lit("["), F.format_string(f"%.{digits}f", lon), F.lit(","), F.format_string(f"%.{digits}f", lat), F.lit(","), flags.cast("string"), F.lit("]"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """``page, html`` as files, one for each page, below ``folder/page=.../``: written by the tasks side by side."""
    pages.select("page", F.col("html").alias("value")).repartition("page").write.partitionBy("page").mode("overwrite").text(folder)


def append_to(spark: SparkSession, path: str, incoming: DataFrame, key: str) -> None:
    """Append to the registry at ``path`` what it doesn't have yet; running it again adds nothing."""
    append_new(spark.read.parquet(path), incoming, key).write.mode("append").parquet(path)
