"""References to records that don't exist."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.operators.skew import skew_join


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` refer by ``child_key`` to the records listed in ``parent`` for the same period."""

    table_name: str
    child: DataFrame
    row_id: str
    child_key: str
    child_period: str
    parent_name: str
    parent: DataFrame
    parent_key: str
    parent_period: str

    def children(self) -> DataFrame:
        return self.child.where(F.col(self.child_key).isNotNull()).select(F.lit(self.parent_name).alias("parent_table"), F.col(self.child_period).cast("string").alias("period"), F.col(self.child_key).cast("string").alias("key"), F.col(self.row_id).alias("row_id"), F.lit(self.table_name).alias("table_name"))

    def parents(self) -> DataFrame:
        return self.parent.select(F.lit(self.parent_name).alias("parent_table"), F.col(self.parent_period).cast("string").alias("period"), F.col(self.parent_key).cast("string").alias("key"))


def orphan_keys(references: list[Reference]) -> DataFrame:
    """``parent_table, period, key, n_<table>...`` of keys referred to but not listed.

    Parent and child keys are united in long form with a tag, grouped by parent table, period and key, and groups
    without the parent's tag are kept. Grouping combines on the map side, so a key of any frequency is one row per task.
    A null key refers to nothing; a null period lists nothing, so a key under it is an orphan of period null. Parents
    of one name from several frames are united.
    """
    names = [r.table_name for r in references]
    listed = {(r.parent_name, id(r.parent), r.parent_key, r.parent_period): r.parents() for r in references}
    no_children = [F.lit(0).alias(f"n_{n}") for n in names]
    long = [p.where(F.col("period").isNotNull()).select("parent_table", "period", "key", F.lit(True).alias("listed"), *no_children) for p in listed.values()]
    long += [r.children().select("parent_table", "period", "key", F.lit(False).alias("listed"), *[F.lit(int(n == r.table_name)).alias(f"n_{n}") for n in names]) for r in references]
    groups = reduce(DataFrame.unionByName, long).groupBy("parent_table", "period", "key")
    return groups.agg(F.bool_or("listed").alias("listed"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n in names]).where(~F.col("listed")).drop("listed")


def orphan_counts(references: list[Reference]) -> DataFrame:
    """Report per table and period: ``table_name, parent_table, period, orphan_rows, orphan_keys``."""
    keys = orphan_keys(references)
    spread = F.array(*[F.struct(F.lit(r.table_name).alias("table_name"), F.when(F.col("parent_table") == r.parent_name, F.col(f"n_{r.table_name}")).otherwise(0).alias("n")) for r in references])
    return keys.select("parent_table", "period", F.inline(spread)).where("n > 0").groupBy("table_name", "parent_table", "period").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys"))


def orphan_rows(references: list[Reference]) -> DataFrame:
    """The rows themselves, each once: ``table_name, period, row_id``. A hot orphan key is salted."""
    marks = ["parent_table", "period", "key"]
    coded = lambda df: df.withColumn("period", F.coalesce("period", F.lit("")))
    keys = coded(orphan_keys(references).select(*marks))
    children = coded(reduce(DataFrame.unionByName, [r.children() for r in references]))
    return skew_join(children, keys, marks, "left_semi").select("table_name", F.nullif("period", F.lit("")).alias("period"), "row_id").distinct()
