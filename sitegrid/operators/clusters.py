"""Entities that share a place: repeated coordinates, shared cells, chains of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.operators.grid import disk
from sitegrid.operators.skew import hot_keys, skew_join
from sitegrid.session import dropped, written

MOST_ROUNDS = 60


def repeated_coordinates(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``lat, lon, n`` of coordinates that more than one row gives exactly; nulls aren't coordinates."""
    return points.dropna(subset=[lat, lon]).groupBy(lat, lon).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def colocation(points: DataFrame, cell: list[str]) -> DataFrame:
    """One row: ``entities, shared_cells, entities_sharing, most_in_a_cell, pct_sharing``."""
    per = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    shared = F.col("n") > 1
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.count_if(shared).alias("shared_cells"), F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("entities_sharing"), F.coalesce(F.max("n"), F.lit(0)).alias("most_in_a_cell"),
        F.round(100.0 * F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)) / F.nullif(F.sum("n"), F.lit(0)), 2).alias("pct_sharing"),
    )


def components(cells: DataFrame, k: int = 1) -> DataFrame:
    """``x, y, component``: occupied cells joined where they are within ``k`` rings; a component is named by its least cell.

    Cells are numbered by (x, y); edges come from exploded disks joined with the cells. Each round takes the least label
    among neighbours and then the label of that label (halving chains), until nothing changes; every round is
    written. Labels stay distributed.
    """
    own = cells.select("x", "y").distinct().withColumn("id", F.col("x") * (1 << 31) + F.col("y"))
    own = written(own, "cells")
    around = own.select("id", F.explode(disk(F.col("x"), F.col("y"), k, 1)).alias("c")).select("id", (F.col("c.x") * (1 << 31) + F.col("c.y")).alias("other"))
    edges = written(around.join(own.select(F.col("id").alias("other")), "other"), "edges")
    labels = written(own.select("id", F.col("id").alias("label")), "labels-0")
    for r in range(1, MOST_ROUNDS + 1):
        heard = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("heard"))
        least = labels.join(heard, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        # a large component's label is hot: which ones are is read from the round before
        jump = skew_join(least, least.select(F.col("id").alias("label"), F.col("label").alias("far")), ["label"], "left", hot=hot_keys(labels, ["label"]))
        following = written(jump.select("id", "old", F.least("label", "far").alias("label")), f"labels-{r}")
        dropped(labels)
        path = following._sitegrid_path
        changed = not following.where("old <> label").isEmpty()
        labels = following.select("id", "label")
        labels._sitegrid_path = path
        if not changed:
            break
    else:
        raise RuntimeError(f"components haven't settled after {MOST_ROUNDS} rounds")
    return own.join(labels, "id").select("x", "y", F.col("label").alias("component"))
