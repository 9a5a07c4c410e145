"""Search, pages of tables, names, published figures, links and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions import text as X
from sitegrid.functions.geo import haversine_m
from sitegrid.operators import search
from sitegrid.operators.verify import Registry, quoted_figures
from sitegrid.plans.profiles import VILLAGES_SQL, villages
from sitegrid.plans.registry import Plans
from sitegrid.sources.sinks import append_new, split_rejects
from sitegrid.sources.tables import table

plans = Plans()
QUERY = "ha"


@plans.query("""with a as (select 'province' kind, 1 kr, upper(trim(regexp_replace(province, '\\s+', ' ', 'g'))) as name, count(*) n from stats_village where province is not null group by 3
union all select 'district', 2, upper(trim(regexp_replace(district, '\\s+', ' ', 'g'))), count(*) from stats_village where district is not null group by 3),
s as (select *, case when lower(name) = 'ha' then 100 when starts_with(lower(name), 'ha') then 80 when contains(' ' || lower(name), ' ha') then 60 when contains(lower(name), 'ha') then 30 else 0 end score from a)
select kind, name, n, score from s where score > 0 order by score desc, kr, n desc, length(name), name limit 12""")
def area_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 12 best areas for a typed query."""
    v = table(spark, folder, "stats_village")
    kinds = []
    for rank, kind in enumerate(("province", "district"), 1):
        name = F.upper(F.trim(F.regexp_replace(kind, "\\s+", " ")))
        kinds.append(v.where(F.col(kind).isNotNull()).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n", F.lit(rank).alias("r")))
    found = search.ranked_search(kinds[0].unionByName(kinds[1]), "name", QUERY, F.col("r"), "n")
    return found.select("kind", "name", "n", "score")


@plans.query("""with f as (select c_custkey, c_name, c_acctbal, c_mktsegment from customer where contains(lower(c_name), 'customer') and contains(lower(c_name), '1') and c_acctbal > 0 and c_mktsegment in ('BUILDING', 'MACHINERY'))
select c_custkey, c_name, c_acctbal, c_mktsegment from f order by c_mktsegment, c_acctbal desc nulls last, c_custkey limit 25 offset (select 25 * least(1, greatest(0, (count(*) + 24) // 25 - 1)) from f)""")
def table_filter_sort_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of filtered, searched and sorted rows (the first where there is one only)."""
    filters = {"positive": F.col("c_acctbal") > 0, "segments": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "negative": F.col("c_acctbal") < 0}
    rows = search.filtered(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), filters, ["positive", "segments"])
    return search.page_of(rows, [F.asc_nulls_last("c_mktsegment"), F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")], 2, 25, ("c_name", "1 customer"))[0]


@plans.query("select doc_id, n_chars from documents where contains(lower(text), 'gudang') order by doc_id limit 8")
def early_stop_scan(spark: SparkSession, folder: str) -> DataFrame:
    return search.first_matches(table(spark, folder, "documents").select("doc_id", "n_chars", "text"), F.lower("text").contains("gudang"), "doc_id").select("doc_id", "n_chars")


@plans.query("""with n as (select distinct district, trim(regexp_replace(lower(district), '[^a-z0-9]+', ' ', 'g')) t from land_assets where district is not null)
select district, case when starts_with(t, 'kabupaten ') then t[11:] when starts_with(t, 'kab ') then t[5:] when starts_with(t, 'kotamadya ') then t[11:] when starts_with(t, 'kota ') then t[6:] else t end as normalised, upper(regexp_replace(district, '[^A-Za-z0-9]', '', 'g')) as letters from n""")
def name_normalise(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "land_assets").where("district is not null").select("district").distinct()
    return rows.select("district", X.admin_name(F.col("district"), ["kabupaten", "kab", "kotamadya", "kota"]).alias("normalised"), X.letters_key(F.col("district")).alias("letters"))


figures = Registry()


@figures.check(published=0)
def negative_values(spark: SparkSession, folder: str) -> DataFrame:
    """No village may report a negative value."""
    return villages(spark, folder, "transaction_value").agg(F.count_if(F.col("transaction_value") < 0))


@figures.check(published=90, tolerance=15, digits=1, suffix="%")
def zero_share(spark: SparkSession, folder: str) -> DataFrame:
    return villages(spark, folder, "transaction_value").agg(100.0 * F.count_if(F.col("transaction_value") == 0) / F.nullif(F.count("transaction_value"), F.lit(0)))


@figures.check(published=38, tolerance=0.5)
def provinces_listed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stats_province").agg(F.count_distinct("province_id"))


@figures.check(published=1)
def missing_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "a_table_that_is_not_there").agg(F.count(F.lit(1)))


_FIGURES_SQL = f"""with {VILLAGES_SQL}, f(key, published, tol, computed, digits, suffix) as (
select 'negative_values', 0.0::double, 0.0::double, (select count(*) filter (where transaction_value < 0)::double from v), 0, '' union all select 'zero_share', 90, 15, (select 100.0 * count(*) filter (where transaction_value = 0) / nullif(count(transaction_value), 0) from v), 1, '%'
union all select 'provinces_listed', 38, 0.5, (select count(distinct province_id)::double from stats_province), 0, '' union all select 'missing_source', 1, 0, null, 0, ''),
r as (select key, published, computed, case when computed is null then 'skip' when abs(computed - published) <= tol + 1e-9 then 'pass' else 'fail' end as status,
case when digits = 0 then translate(format('{{:,}}', cast(round(computed) as bigint)), ',', '.') else translate(format('{{:,}}', cast(trunc(round(computed, 1)) as bigint)), ',', '.') || ',' || cast(cast(round(round(computed, 1) * 10) as bigint) % 10 as varchar) end || suffix as rendered from f)"""


@plans.query(_FIGURES_SQL + " select key, published, round(computed, 4) as computed, status, rendered from r")
def figure_checks(spark: SparkSession, folder: str) -> DataFrame:
    return figures.run(spark, folder).withColumn("computed", F.round("computed", 4))


@plans.query(_FIGURES_SQL + """, q(page, key, quoted) as (values ('a.html', 'provinces_listed', '38'), ('a.html', 'zero_share', '12,0%'), ('b.html', 'no_such_figure', '7'))
select page, q.key, quoted, case when r.rendered is null then 'unknown' when trim(quoted) = rendered then 'ok' else 'stale' end as status from q left join r on q.key = r.key and r.status = 'pass'""")
def quoted_text(spark: SparkSession, folder: str) -> DataFrame:
    """Figures quoted in page texts against those that passed."""
    pages = spark.createDataFrame([("a.html", '<p><b data-figure="provinces_listed">38</b> of <i data-figure="zero_share" class="n">12,0%</i></p>'), ("b.html", '<b data-figure="no_such_figure">7</b>')], "page string, html string")
    return quoted_figures(pages, figures.run(spark, folder))


_PAGES_SQL = """pg as (select 'areas/' || n_nationkey || '/index.html' as page, '<a href="../' || ((n_nationkey + 1) % 30) || '/index.html#top">next</a> <a href="https://example.org/">out</a> <img src="./map.png?x=1">' as html from nation),
ln as (select page, unnest(['../' || ((n_nationkey + 1) % 30) || '/index.html#top', 'https://example.org/', './map.png?x=1']) as url, n_nationkey k from nation join pg on page = 'areas/' || n_nationkey || '/index.html'),
rs as (select page, url, case when starts_with(url, 'https') then null when starts_with(url, '..') then 'areas/' || ((k + 1) % 30) || '/index.html' else 'areas/' || k || '/map.png' end as target from ln)"""


def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages made from nations, and their links with where they lead; the last ones lead nowhere."""
    n = table(spark, folder, "nation")
    key = F.col("n_nationkey")
    html = F.concat(F.lit('<a href="../'), ((key + 1) % 30).cast("string"), F.lit('/index.html#top">next</a> <a href="https://example.org/">out</a> <img src="./map.png?x=1">'))
    pages = n.select(F.concat(F.lit("areas/"), key.cast("string"), F.lit("/index.html")).alias("page"), html.alias("html"))
    urls = pages.select("page", F.explode(X.links(F.col("html"))).alias("url"))
    return pages, urls.withColumn("target", F.when(~X.is_external(F.col("url")), X.resolved(F.col("page"), F.col("url"))))


@plans.query(f"with {_PAGES_SQL} select * from rs")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder)[1]


@plans.query(f"with {_PAGES_SQL} select page, url, target from rs where target is not null and not exists (select 1 from pg where pg.page = rs.target)")
def broken_links(spark: SparkSession, folder: str) -> DataFrame:
    pages, links = _links(spark, folder)
    return links.where(F.col("target").isNotNull()).join(pages.select(F.col("page").alias("target")), "target", "left_anti").select("page", "url", "target")


_SENTENCES_SQL = "s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') l from documents)"


@plans.query(f"with {_SENTENCES_SQL} select doc_id, cast(len(l) as integer) as n_sentences, list_filter(l, lambda x: contains(x, '!'))[1] as with_mark from s")
def doc_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per document and the first that holds an exclamation mark."""
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.size(X.sentences(t)).alias("n_sentences"), X.sentence_with(t, "!").alias("with_mark"))


@plans.query("with d as (select doc_id, regexp_extract(text, '([-]?[0-9]{1,2}\\.[0-9]{4,6}), ([0-9]{2,3}\\.[0-9]{4,6})', 1) a, regexp_extract(text, '([-]?[0-9]{1,2}\\.[0-9]{4,6}), ([0-9]{2,3}\\.[0-9]{4,6})', 2) b from documents) select doc_id, a::double as lat, b::double as lon from d where a <> ''")
def captured_points(spark: SparkSession, folder: str) -> DataFrame:
    """The first coordinate pair written in a text."""
    pattern = "([-]?[0-9]{1,2}\\.[0-9]{4,6}), ([0-9]{2,3}\\.[0-9]{4,6})"
    rows = table(spark, folder, "documents").select("doc_id", F.regexp_extract("text", pattern, 1).alias("a"), F.regexp_extract("text", pattern, 2).alias("b"))
    return rows.where("a <> ''").select("doc_id", F.col("a").cast("double").alias("lat"), F.col("b").cast("double").alias("lon"))


@plans.query("select o_orderkey, translate(format('{:,}', cast(trunc(round(o_totalprice)) as bigint)), ',', '.') as printed, case when o_totalprice < 1000 then round(o_totalprice)::bigint || ' m' else format('{:.1f} km', o_totalprice / 1000) end as label from orders")
def number_rendering_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every order's price as a published number and as a distance."""
    return _rendered(table(spark, folder, "orders"))


def _rendered(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    return orders.select("o_orderkey", X.published_number(price).alias("printed"), X.distance_label(price).alias("label"))


_BODIES_SQL = """b as (select c_custkey id, 'cooperative_id: ' || c_custkey || chr(10) || 'lat: ' || ((c_custkey * 7919) % 2200000 - 1100000) / 100000 || chr(10) || 'lon: ' || (9500000 + (c_custkey * 104729) % 4600000) / 100000 as body, ((c_custkey * 7919) % 2200000 - 1100000) / 100000 lat, (9500000 + (c_custkey * 104729) % 4600000) / 100000 lon from customer),
m as (select b.*, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat + 2.5) / 2), 2) + cos(radians(-2.5)) * cos(radians(lat)) * pow(sin(radians(lon - 118) / 2), 2)))) d from b),
j as (select id, lat, lon, case when not (lat between -11 and 6 and lon between 95 and 141) then 'bounds' when not d <= 2000000 then 'too far' end reason from m)"""


def _corrections(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Corrections read from message bodies, split into accepted and rejected."""
    k = F.col("c_custkey")
    lat, lon = (F.pmod(k * 7919, F.lit(2_200_000)) - 1_100_000) / 100_000, (F.pmod(k * 104_729, F.lit(4_600_000)) + 9_500_000) / 100_000
    body = F.concat(F.lit("cooperative_id: "), k.cast("string"), F.lit("\nlat: "), lat.cast("string"), F.lit("\nlon: "), lon.cast("string"))
    bodies = table(spark, folder, "customer").select(body.alias("body"))
    parsed = bodies.select(F.expr("try_cast(regexp_extract(body, 'cooperative_id: ([0-9]+)', 1) as bigint)").alias("id"), *[F.expr(f"try_cast(regexp_extract(body, '{n}: (-?[0-9.]+(E-?[0-9]+)?)', 1) as double)").alias(n) for n in ("lat", "lon")])
    inside = F.col("lat").between(-11, 6) & F.col("lon").between(95, 141)
    near = haversine_m(F.lit(-2.5), F.lit(118.0), F.col("lat"), F.col("lon")) <= 2_000_000
    return split_rejects(parsed, {"bounds": inside, "too far": near})


@plans.query(f"with {_BODIES_SQL} select id, lat::double as lat, lon::double as lon from j where reason is null and id % 10 <> 0")
def correction_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted corrections that the registry (every tenth, already there) lacks; appending them again adds nothing."""
    accepted, _ = _corrections(spark, folder)
    registry = table(spark, folder, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"))
    return append_new(registry, accepted, "id")


@plans.query(f"with {_BODIES_SQL} select reason as _reason, count(*) as n from j where reason is not null group by 1")
def correction_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _corrections(spark, folder)[1].groupBy("_reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = plans.queries, plans.oracle
