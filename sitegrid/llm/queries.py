"""Queries of the training-data operators over the registry's tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm.leakage import leaked_items
from sitegrid.llm.matching import match_records, owner_mentions, record_mentions
from sitegrid.llm.mixing import mix_report, mix_sources
from sitegrid.llm.names import learned, name_frame
from sitegrid.llm.splitting import split_oversized
from sitegrid.llm.tokens import token_sizes
from sitegrid.llm.topn import latest_of, top_n
from sitegrid.session import dropped, written
from sitegrid.sources.tables import table


#: A pair is a match from this marginal probability on.
LEAST_CONFIDENCE = 0.5
TOP = 5


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate pair with its marginal probability of a match."""
    owners, records = table(spark, folder, "cemetery_candidates"), table(spark, folder, "land_assets")
    names = written(name_frame([(owners, "cooperative"), (records, "cooperative")]), "names")
    common = learned(names)
    dropped(names)
    found = match_records(owner_mentions(owners, common=common), record_mentions(records, common=common))
    return found.select(F.col("owner").alias("cooperative_id"), F.col("record").alias("asset_id"), "confidence")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_matches(spark, folder).where(F.col("confidence") >= LEAST_CONFIDENCE).select("cooperative_id", "asset_id")


def _top_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "kopdes_province_top_products")
    name = F.trim(F.regexp_replace(F.lower("province"), "[\\s\\u00a0]+", " "))
    rows = latest_of(lines.withColumn("province", name), "line_id", "reported_at", ["pull_id", "province", "product", "value", "volume"])
    return top_n(rows.withColumn("volume", F.nanvl("volume", F.lit(None).cast("double"))), ["pull_id", "province"], TOP, [("value", "desc"), ("volume", "desc")], "line_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _top_lines(spark, folder).select("pull_id", "line_id")


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    return _top_lines(spark, folder)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that leaked, with the documents that hold them and the largest share."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.max("share"), 4).alias("largest_share"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = written(token_sizes(table(spark, folder, "documents"), "text", ["doc_id", "source"]), "token-sizes")
    return mix_sources(sizes, table(spark, folder, "mix_targets"), "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(p8_mix(spark, folder), table(spark, folder, "mix_targets"), "doc_id").withColumn("actual_share", F.round("actual_share", 6))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), "doc_id", "text", with_text=False).where("piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p5_found, p5_top, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_pieces)}
_TOP = """
with latest as (
  select pull_id, trim(regexp_replace(lower(province), '[\\s\u00a0]+', ' ', 'g')) as province, value, volume, line_id from kopdes_province_top_products where line_id is not null
  qualify row_number() over (partition by line_id order by reported_at desc nulls last, pull_id desc, value desc) = 1
), ranked as (
  select *, row_number() over (partition by pull_id, province order by value desc, volume desc nulls last, line_id) as rank from latest where value is not null and not isnan(value)
)
"""
ORACLE: dict[str, str] = {
    "p5_found": _TOP + "select pull_id, line_id from ranked where rank <= 5",
    "p5_top": _TOP + "select pull_id, province, line_id, value, volume, cast(rank as integer) as rank from ranked where rank <= 5",
}
