"""Published figures: registered checks with tolerances, and texts that quote them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions.text import published_number

#: Added to every tolerance for the binary rounding of decimals.
SLACK = 1e-9


@dataclass(frozen=True)
class Check:
    """A figure: where it is published, its value there, and a one-value frame that computes it anew."""

    key: str
    published: float
    compute: Callable[[SparkSession, str], DataFrame]
    tolerance: float = 0.0
    digits: int = 0
    suffix: str = ""


@dataclass
class Registry:
    """Checks by key, registered with a decorator."""

    checks: dict[str, Check] = field(default_factory=dict)

    def check(self, published: float, tolerance: float = 0.0, digits: int = 0, suffix: str = "") -> Callable:
        def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.checks[f.__name__] = Check(f.__name__, published, f, tolerance, digits, suffix)
            return f

        return register

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        """``key, published, computed, status, rendered``: status is pass, fail, or skip where a source is missing or the value is null."""
        rows = []
        for c in self.checks.values():
            try:
                one = c.compute(spark, folder)
                value = F.col(f"`{one.columns[0]}`").cast("double")
                one = one.select(value.alias("computed"))
            except AnalysisException:
                one = spark.createDataFrame([(None,)], "computed double")
            status = F.when(F.col("computed").isNull(), "skip").when(F.abs(F.col("computed") - c.published) <= c.tolerance + SLACK, "pass").otherwise("fail")
            rows.append(one.select(F.lit(c.key).alias("key"), F.lit(float(c.published)).alias("published"), "computed", status.alias("status"), published_number(F.col("computed"), c.digits, c.suffix).alias("rendered")))
        return reduce(DataFrame.unionByName, rows)


def quoted_figures(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """``page, key, quoted, status`` of elements ``<x data-figure="key">text</x>``: ok, stale or unknown against passing figures."""
    found = pages.select("page", F.explode(F.regexp_extract_all("html", F.lit('data-figure="([^"]*)"[^>]*>'), F.lit(1))).alias("key"), "html")
    quoted = found.select("page", "key", F.expr("""regexp_extract(html, concat('data-figure="', key, '"[^>]*>([^<]*)<'), 1)""").alias("quoted"))
    passing = figures.where("status = 'pass'").select("key", "rendered")
    joined = quoted.join(passing, "key", "left")
    status = F.when(F.col("rendered").isNull(), "unknown").when(F.trim("quoted") == F.col("rendered"), "ok").otherwise("stale")
    return joined.select("page", "key", "quoted", status.alias("status"))
