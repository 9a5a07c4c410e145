"""History of changing attributes: versions with their period, from periodic snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The end of a version that is still valid.
OPEN_END = "9999-12-31"


def snapshots_of(df: DataFrame, entity: str, received: str, snapshots: list[tuple[str, list[str]]], attributes: list[str]) -> DataFrame:
    """Long form of a table that has a group of columns per snapshot: one row per entity and snapshot with a value.

    ``snapshots``: (date, columns in the order of ``attributes``). Of several rows of an entity, the one with the latest
    ``received`` whose columns of that snapshot are all present counts; a NaN is missing; a null ``received`` is the
    oldest; further ties go to the largest values. Rows without an entity are left out. One aggregation with map-side
    combine, so an entity of any number of rows is no hot group.
    """

    def present(c: str) -> Column:
        numeric = dict(df.dtypes)[c] in ("double", "float")
        return F.col(c).isNotNull() & ~F.isnan(c) if numeric else F.col(c).isNotNull()

    latest = [F.max(F.when(reduce(lambda a, b: a & b, [present(c) for c in cols]), F.struct(F.col(received).alias("at"), *[F.col(c).alias(a) for c, a in zip(cols, attributes, strict=True)]))).alias(f"s{i}") for i, (_, cols) in enumerate(snapshots)]
    wide = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*latest)
    versions = F.array(*[F.when(F.col(f"s{i}").isNotNull(), F.struct(F.lit(day).alias("snapshot"), *[F.col(f"s{i}.{a}").alias(a) for a in attributes])) for i, (day, _) in enumerate(snapshots)])
    return wide.select(entity, F.inline(F.filter(versions, lambda v: v.isNotNull())))


def attribute_history(snapshots: DataFrame, entity: str, snapshot: str, attributes: list[str], tolerance: float = 0.0) -> DataFrame:
    """Versions of each entity: ``entity, version, <attributes>, valid_from, valid_to``.

    Gaps and islands over one row per entity and snapshot: the hash of the attributes is compared with the row before
    (lag); where it is unlike and some number moved by more than ``tolerance`` (or another attribute differs), a version
    starts; the running sum of starts numbers the islands; the least snapshot of an island is its start and the next
    start its end, the last ends at ``9999-12-31``. Attributes are those of the version's first snapshot. A null
    attribute is a value of its own. The window holds one entity's snapshots, of which there are as many as deliveries.
    """
    w = Window.partitionBy(entity).orderBy(snapshot)
    kinds = dict(snapshots.dtypes)

    def moved(a: str) -> Column:
        here, before = F.col(a), F.col(f"__before.{a}")
        if kinds[a] in ("double", "float") and tolerance > 0:
            return F.when(here.isNull() | before.isNull(), ~here.eqNullSafe(before)).otherwise(F.abs(here - before) > tolerance)
        return ~here.eqNullSafe(before)

    marked = snapshots.withColumn("__hash", F.xxhash64(*attributes)).withColumns({"__before": F.lag(F.struct("__hash", *attributes)).over(w)})
    unlike = F.col("__before").isNull() | ((F.col("__hash") != F.col("__before.__hash")) & reduce(lambda a, b: a | b, [moved(a) for a in attributes]))
    islands = marked.withColumn("version", F.sum(unlike.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = islands.groupBy(entity, "version").agg(F.min(F.struct(snapshot, *attributes)).alias("__first"))
    following = F.lead(F.col(f"__first.{snapshot}")).over(Window.partitionBy(entity).orderBy("version"))
    return starts.select(entity, "version", *[F.col(f"__first.{a}").alias(a) for a in attributes], F.col(f"__first.{snapshot}").cast("string").alias("valid_from"), F.coalesce(following.cast("string"), F.lit(OPEN_END)).alias("valid_to"))
