"""Places of rows in a global order, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.session import written


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of each row in ``order``, which should be total.

    Rows are range-partitioned and sorted by the order and written once; each part's rows are numbered by itself, and what
    precedes a part is the sum of the counts of those before it (a number per part, on the driver). Any sortable types,
    collations and null placements.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number's upper 31 bits are the part's, the lower 33 the row's place in it
    marked = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r["p"], before))
        before += r["n"]
    start = F.lit(0)
    if starts:
        start = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p, _ in starts]), F.array(*[F.lit(b) for _, b in starts])), part)
    return marked.withColumn(name, (start + inside + 1).cast("bigint")).select(*df.columns, name)


def resolved_names(left: DataFrame, right: DataFrame, left_name: Column, right_name: Column, keep: Sequence[str]) -> DataFrame:
    """``left`` with ``keep`` of the one row of ``right`` of the same (normalised) name; a one-to-one map or an error.

    The plan fails at run time where a name of ``left`` has no counterpart or several, or is null, and where two rows of
    ``left`` lead to one row of ``right``.
    """
    per = lambda df, name, columns: df.groupBy(name.alias("__name")).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in columns])
    found = per(right, right_name, keep)
    uses = left.groupBy(left_name.alias("__name")).agg(F.count(F.lit(1)).alias("__uses"))
    joined = left.withColumn("__name", left_name).join(found, "__name", "left").join(uses, "__name", "left")
    say = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col("__name").cast("string"), F.lit("null"))))
    checked = F.when(F.col("__n").isNull(), say("no counterpart of ")).when(F.col("__n") > 1, say("several counterparts of ")).when(F.coalesce("__uses", F.lit(0)) != 1, say("not one to one: ")).otherwise(F.lit(True))
    return joined.where(checked).select(*left.columns, *keep)


def aligned(left: DataFrame, right: DataFrame, on: Sequence[str], measures: Sequence[str], fill: float = 0) -> DataFrame:
    """``on..., <m>_left, <m>_right, <m>_difference`` of two grouped frames aligned by group: a group of one side only is
    filled on the other. Null keys align with null keys."""
    sides = [df.select(*on, *[F.col(m).alias(f"{m}_{s}") for m in measures], *[F.lit(None).cast(df.schema[m].dataType).alias(f"{m}_{t}") for m in measures]) for df, s, t in ((left, "left", "right"), (right, "right", "left"))]
    both = reduce(DataFrame.unionByName, sides).groupBy(*on).agg(*[F.coalesce(F.max(f"{m}_{s}"), F.lit(fill)).alias(f"{m}_{s}") for m in measures for s in ("left", "right")])
    return both.withColumns({f"{m}_difference": F.col(f"{m}_left") - F.col(f"{m}_right") for m in measures})
