"""Star joins, links over names, overrides and outer rollups: the building of wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.operators.dedup import first_by, latest_by


def folded(c: Column | str) -> Column:
    """A name for joining: upper case, single blanks, none at the ends."""
    return F.upper(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "\\s+", " ")))


def star_join(facts: DataFrame, dimensions: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins of dimensions that have one row per key; Spark broadcasts those it measures as small."""
    for dimension, on in dimensions:
        facts = facts.join(dimension, on, "left")
    return facts


def name_path_join(left: DataFrame, right: DataFrame, names: list[str], keep: list[str], order: list[Column | str]) -> DataFrame:
    """Left join on a path of names (province, district, ...) compared without case and surplus blanks.

    ``right`` is cut to one row per path (the first in ``order``), so rows can't multiply; a path with a null matches
    nothing.
    """
    marks = [f"__{n}" for n in names]
    keyed = right.select(*[folded(n).alias(m) for n, m in zip(names, marks, strict=True)], *keep, *[c for c in order if isinstance(c, str) and c not in keep])
    unique = first_by(keyed.dropna(subset=marks), marks, order).select(*marks, *keep)
    return left.withColumns({m: folded(n) for n, m in zip(names, marks, strict=True)}).join(unique, marks, "left").drop(*marks)


def override_latest(base: DataFrame, overrides: DataFrame, key: str, at: str, columns: dict[str, str], source: str = "source") -> DataFrame:
    """``base`` with columns replaced by those of the latest override of its key, and where each row's values are from.

    ``columns``: column of base -> column of overrides. A null in an override leaves the base's value.
    """
    latest = latest_by(overrides.select(key, at, *columns.values()), [key], at).select(key, *[F.col(o).alias(f"__o_{b}") for b, o in columns.items()], F.lit(True).alias("__has"))
    joined = base.join(latest, key, "left")
    replaced = {b: F.coalesce(F.col(f"__o_{b}"), F.col(b)) for b in columns}
    return joined.withColumns(replaced | {source: F.when(F.col("__has"), "override").otherwise("base")}).drop("__has", *[f"__o_{b}" for b in columns])


def outer_rollup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Two rollups of the same level side by side; groups of only one side have nulls on the other."""
    return left.join(right, on, "full_outer")


def cascade_match(left: DataFrame, right: DataFrame, parent: str, left_name: str, right_name: str, keep: str, cutoff: float = 0.82) -> DataFrame:
    """``left`` with the ``keep`` of the right row of the same parent, matched exactly, else by the most similar name.

    Names are compared folded; a similar name must reach ``cutoff`` (1 - Levenshtein distance / longer length); ties go
    to the lesser name. Names are never compared across parents, and exactly matched rows aren't compared again; a parent's
    children are an administrative list (hundreds at most), so a typed name meets no more than that.
    Adds ``match`` (exact, similar or null) and ``similarity``. ``left`` needs distinct (parent, name) pairs only:
    names are matched once each, whatever their frequency.
    """
    r = right.select(F.col(parent).alias("__p"), folded(right_name).alias("__r"), F.col(keep).alias("__k")).dropna(subset=["__p", "__r"])
    r = first_by(r, ["__p", "__r"], ["__k"])
    names = left.select(F.col(parent).alias("__p"), folded(left_name).alias("__l")).dropna().distinct()
    exact = names.join(r, (names["__p"] == r["__p"]) & (names["__l"] == r["__r"])).select(names["__p"], "__l", "__k", F.lit("exact").alias("match"), F.lit(1.0).alias("similarity"))
    rest = names.join(exact.select("__p", "__l"), ["__p", "__l"], "left_anti")
    score = 1 - F.levenshtein("__l", "__r") / F.greatest(F.length("__l"), F.length("__r"), F.lit(1))
    near = rest.join(r, "__p").withColumn("similarity", F.round(score, 4)).where(F.col("similarity") >= cutoff)
    best = near.groupBy("__p", "__l").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "__r", "__k")).alias("b"))
    similar = best.select("__p", "__l", F.col("b.__k").alias("__k"), F.lit("similar").alias("match"), (-F.col("b.s")).alias("similarity"))
    found = exact.unionByName(similar)
    joined = left.withColumns({"__p": F.col(parent), "__l": folded(left_name)}).join(found, ["__p", "__l"], "left")
    return joined.withColumnRenamed("__k", f"matched_{keep}").drop("__p", "__l")
