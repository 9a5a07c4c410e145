"""One row per key, audits of repeated keys, and guards against joins that fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order`` (which should be total: rows that tie are kept in no set order).

    Null keys form one key. Spark cuts each input partition to its first row per key before the shuffle
    (WindowGroupLimit), so a hot key costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def latest_by(df: DataFrame, keys: list[str], at: str, columns: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest ``at``; ties go to the greatest remaining columns. Map-side combined."""
    rest = [c for c in (columns or df.columns) if c not in keys and c != at]
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in rest])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def duplicate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``n_rows, n_keys, n_repeated_rows, n_repeated_keys, most_rows``. Two-stage, so no distinct in one task."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated_rows"), F.count_if(F.col("n") > 1).alias("n_repeated_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most_rows"))


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A left or inner join that can't fan out: the plan fails at run time where ``right`` repeats a key that is used."""
    counted = right.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    guarded = counted.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"a key of {on} repeats: the join would fan out"))).otherwise(F.col("__n")))
    joined = left.join(guarded, on, how)
    return joined.where(F.coalesce(F.col("__n"), F.lit(1)) == 1).drop("__n")
