"""Links in steps, wide stars, collated order, name maps, tiles, pages, layers, encrypted records and registries as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions import text as X
from sitegrid.operators import rings, stars, stats
from sitegrid.operators.dedup import latest_by
from sitegrid.operators.order import aligned, numbered, resolved_names
from sitegrid.operators.stars import folded
from sitegrid.operators.tiles import Sampler, window_class, window_relief
from sitegrid.operators.verify import quoted_figures
from sitegrid.plans.profiles import LAST, VILLAGES_SQL, villages
from sitegrid.plans.registry import Plans
from sitegrid.plans.rollups import _DAY_SQL, _day
from sitegrid.plans.spatial import POINTS_SQL, coops, in_cells, markets
from sitegrid.plans.statistics import _REDRAW_SQL, NEAR, _redraws
from sitegrid.plans.texts import _FIGURES_SQL, _corrections, _links, figures
from sitegrid.session import shared_folder
from sitegrid.sources import files, geopackage, osm, sinks
from sitegrid.sources.tables import table

plans = Plans()
_F = "upper(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_LINK_NAMES = ["province", "district", "subdistrict"]


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# joins


@plans.query(f"""with {VILLAGES_SQL}, la as (select * from land_assets qualify row_number() over (partition by asset_id order by surveyed_at desc) = 1),
an as (select {_F.format('cooperative')} n, {_F.format('province')} p, {_F.format('district')} d, asset_id, subdistrict s, village vi from la where cooperative is not null and province is not null and district is not null qualify row_number() over (partition by n, p, d order by asset_id) = 1),
vs as (select {_F.format('province')} p, {_F.format('district')} d, {_F.format('subdistrict')} s, {_F.format('village')} vi, village_id from v where province is not null and district is not null and subdistrict is not null and village is not null qualify row_number() over (partition by p, d, s, vi order by village_id) = 1),
co as (select distinct cooperative_id, cooperative, province, district from cemetery_candidates where cooperative_id is not null)
select cooperative_id, cooperative, asset_id, vs.village_id from co left join an on {_F.format('co.cooperative')} = an.n and {_F.format('co.province')} = an.p and {_F.format('co.district')} = an.d
left join vs on vs.p = {_F.format('co.province')} and vs.d = {_F.format('co.district')} and vs.s = {_F.format('an.s')} and vs.vi = {_F.format('an.vi')}""")
def two_hop_link(spark: SparkSession, folder: str) -> DataFrame:
    """From a cooperative's name to its asset, and from the asset's place names to the village."""
    c = table(spark, folder, "cemetery_candidates").where("cooperative_id is not null").select("cooperative_id", "cooperative", "province", "district").distinct()
    assets = latest_by(table(spark, folder, "land_assets"), ["asset_id"], "surveyed_at", ["asset_id", "surveyed_at", "cooperative", "province", "district", "subdistrict", "village"])
    hop = stars.name_path_join(c, assets, ["cooperative", "province", "district"], ["asset_id", "subdistrict", "village"], ["asset_id"])
    names = ["province", "district", "subdistrict", "village"]
    return stars.name_path_join(hop, villages(spark, folder, *names), names, ["village_id"], ["village_id"]).select("cooperative_id", "cooperative", "asset_id", "village_id")


_OTHER_DAYS = ["2026-08-05", "2026-08-09", "2026-08-13"]
_MART_DIMENSIONS = {
    **{f"d{i}": ("village_id", f"(select village_id, transaction_value as value_{d[8:]} from {_DAY_SQL.format(d)})") for i, d in enumerate(_OTHER_DAYS)},
    "diffs": ("village_id", "(select village_id, count(distinct diff_id) n_diffs from snapshot_diff_changed_villages where village_id is not null group by 1)"),
    "sp": ("province_id", f"(select province_id, max(cooperatives) listed from stats_province where snapshot_date = date '{LAST}' group by 1)"),
    "he": ("province_id", "(select province_id, count(distinct index_id) n_runs from health_index_by_province where province_id is not null group by 1)"),
    "hs": ("province_id", "(select province_id, max(health_score) best_score from health_index_by_province where province_id is not null group by 1)"),
    "pl": ("province_id", "(select province_id, count(distinct line_id) n_lines from kopdes_province_top_products where province_id is not null group by 1)"),
    "pu": ("province_id", "(select province_id, count(distinct pull_id) n_pulls from kopdes_province_top_products where province_id is not null group by 1)"),
    "dc": ("district_id", "(select district_id, count(*) n_documents from documents where district_id is not null group by 1)"),
    "dv": ("district_id", "(select district_id, count(*) villages_in_district from v group by 1)"),
    "sv": ("subdistrict_id", "(select subdistrict_id, count(*) villages_in_subdistrict from v group by 1)"),
    "pv": ("province_id", "(select province_id, sum(accounts_count)::bigint province_accounts from v group by 1)"),
    "ca": ("names", f"(select {_F.format('province')} || '/' || {_F.format('district')} names, count(distinct cooperative_id) n_screened from cemetery_candidates where province is not null and district is not null group by 1)"),
}


@plans.query(f"with {VILLAGES_SQL}, b as (select *, {_F.format('province')} || '/' || {_F.format('district')} names from v) select b.village_id, b.transaction_value, value_05, value_09, value_13, n_diffs, listed, n_runs, best_score, n_lines, n_pulls, n_documents, villages_in_district, villages_in_subdistrict, province_accounts, n_screened from b " + " ".join(f"left join {sql} {name} on b.{key} = {name}.{key}" for name, (key, sql) in _MART_DIMENSIONS.items()))
def village_mart(spark: SparkSession, folder: str) -> DataFrame:
    """A star of fourteen left joins on ids and names: each dimension has one row per key, so rows can't multiply."""
    v = villages(spark, folder, "province_id", "district_id", "subdistrict_id", "province", "district", "transaction_value", "accounts_count")
    names = F.concat(folded("province"), F.lit("/"), folded("district")).alias("names")
    count = lambda t, key, what, name, distinct=True: table(spark, folder, t).where(F.col(key).isNotNull()).groupBy(key).agg((F.count_distinct(what) if distinct else F.count(F.lit(1))).alias(name))
    dimensions = [(_day(spark, folder, d).select("village_id", F.col("transaction_value").alias(f"value_{d[8:]}")), ["village_id"]) for d in _OTHER_DAYS]
    dimensions += [
        (count("snapshot_diff_changed_villages", "village_id", "diff_id", "n_diffs"), ["village_id"]),
        (table(spark, folder, "stats_province").where(F.col("snapshot_date") == F.lit(LAST).cast("date")).groupBy("province_id").agg(F.max("cooperatives").alias("listed")), ["province_id"]),
        (count("health_index_by_province", "province_id", "index_id", "n_runs"), ["province_id"]),
        (table(spark, folder, "health_index_by_province").where("province_id is not null").groupBy("province_id").agg(F.max("health_score").alias("best_score")), ["province_id"]),
        (count("kopdes_province_top_products", "province_id", "line_id", "n_lines"), ["province_id"]),
        (count("kopdes_province_top_products", "province_id", "pull_id", "n_pulls"), ["province_id"]),
        (count("documents", "district_id", "doc_id", "n_documents", False), ["district_id"]),
        (v.where("district_id is not null").groupBy("district_id").agg(F.count(F.lit(1)).alias("villages_in_district")), ["district_id"]),
        (v.where("subdistrict_id is not null").groupBy("subdistrict_id").agg(F.count(F.lit(1)).alias("villages_in_subdistrict")), ["subdistrict_id"]),
        (v.where("province_id is not null").groupBy("province_id").agg(F.sum("accounts_count").alias("province_accounts")), ["province_id"]),
        (table(spark, folder, "cemetery_candidates").where("province is not null and district is not null").groupBy(names).agg(F.count_distinct("cooperative_id").alias("n_screened")), ["names"]),
    ]
    facts = v.select("village_id", "province_id", "district_id", "subdistrict_id", names, "transaction_value")
    return stars.star_join(facts, dimensions).drop("province_id", "district_id", "subdistrict_id", "names")


@plans.query(f"with a as (select distinct province_id, {_F.format('province')} as province from stats_village where province is not null), b as (select {_F.format('province')} p, province as listed_as, latitude from stats_province where snapshot_date = date '{LAST}') select province_id, province, listed_as, latitude from a join b on province = p")
def name_map(spark: SparkSession, folder: str) -> DataFrame:
    """Provinces of the villages mapped one to one to the listed ones by name; an unmatched name is an error."""
    used = table(spark, folder, "stats_village").where("province is not null").select("province_id", folded("province").alias("province")).distinct()
    listed = table(spark, folder, "stats_province").where(F.col("snapshot_date") == F.lit(LAST).cast("date")).select(F.col("province").alias("listed_as"), "latitude")
    return resolved_names(used, listed, F.col("province"), folded("listed_as"), ["listed_as", "latitude"])


@plans.query("""with a as (select s_nationkey k, count(*) n, round(sum(s_acctbal), 2) total from supplier where s_suppkey % 3 = 0 group by 1), b as (select s_nationkey k, count(*) n, round(sum(s_acctbal), 2) total from supplier where s_suppkey % 3 <> 0 group by 1)
select coalesce(a.k, b.k) as nationkey, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right, coalesce(a.n, 0) - coalesce(b.n, 0) as n_difference, coalesce(a.total, 0) as total_left, coalesce(b.total, 0) as total_right, round(coalesce(a.total, 0) - coalesce(b.total, 0), 2) as total_difference from a full join b on a.k = b.k""")
def aligned_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Two halves of the suppliers grouped by nation, aligned and subtracted; a nation of one half only counts 0 in the other."""
    s = table(spark, folder, "supplier").withColumn("nationkey", F.col("s_nationkey"))
    half = lambda c: s.where(c).groupBy("nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    return aligned(half(F.col("s_suppkey") % 3 == 0), half(F.col("s_suppkey") % 3 != 0), ["nationkey"], ["n", "total"]).withColumn("total_difference", F.round("total_difference", 2))


# order


@plans.query("""with d as (select district, count(*) n from land_assets group by 1) select 'up' as direction, row_number() over (order by lower(district) nulls last, district) as place, district, n from d
union all select 'down', row_number() over (order by lower(district) desc nulls last, district desc), district, n from d""")
def collated_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Typed district names in an order that ignores case, every one with its place; the missing one is last in both
    directions."""
    d = table(spark, folder, "land_assets").groupBy("district").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.collate("district", "UTF8_LCASE"))
    up = numbered(d, [F.asc_nulls_last("key"), F.asc_nulls_last("district")]).select(F.lit("up").alias("direction"), "place", "district", "n")
    return up.unionByName(numbered(d, [F.desc_nulls_last("key"), F.desc_nulls_last("district")]).select(F.lit("down").alias("direction"), "place", "district", "n"))


# tiles

_TILE = "case when floor(lat) < 0 then 'S' else 'N' end || lpad(abs(floor(lat)::int)::varchar, 2, '0') || case when floor(lon) < 0 then 'W' else 'E' end || lpad(abs(floor(lon)::int)::varchar, 3, '0')"
_TILED_SQL = f"""{POINTS_SQL}, sp as (select id, {_TILE} tile, floor(lat)::int la, floor(lon)::int lo, least(9, floor((lat - floor(lat)) * 10)::int) r, least(9, floor((lon - floor(lon)) * 10)::int) c from pt),
ok as (select *, (la + lo) % 7 <> 0 as there from sp), cells as (select id, tile, there, r, c, i, (r + i // 3 - 1) rr, (c + i % 3 - 1) cc, (((r + i // 3 - 1) * 7 + (c + i % 3 - 1) * 3 + abs(la) * 5 + lo) % 50)::double v from ok, range(0, 9) t(i)), win as (select * from cells where there and rr between 0 and 9 and cc between 0 and 9)"""


def _tiles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Places and the tiles (10 by 10 cells a degree) that there are for them: some are missing."""
    p = coops(spark, folder).select("point_id", "lat", "lon")
    corner = p.select(F.floor("lat").alias("la"), F.floor("lon").alias("lo")).distinct().where((F.col("la") + F.col("lo")) % 7 != 0)
    cells = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: ((F.floor(i / 10) * 7 + (i % 10) * 3 + F.abs("la") * 5 + F.col("lo")) % 50).cast("double"))
    return p, corner.select(files.tile_name(F.col("la"), F.col("lo")).alias("tile"), cells.alias("cells"))


def _sampler(reach: int) -> Sampler:
    inside = lambda x: F.least(F.lit(9), F.floor((x - F.floor(x)) * 10).cast("int"))
    return Sampler(files.tile_name, lambda lat, _: inside(lat), lambda _, lon: inside(lon), 10, reach)


@plans.query(f"with {_TILED_SQL} select ok.id as point_id, ok.tile, v as value, case when not ok.there then 'no tile' end as error from ok left join win on ok.id = win.id and i = 4")
def tile_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The raster's value at every place; a place whose tile is missing has an error of its own."""
    return _sampler(0).sample(*_tiles(spark, folder)).select("point_id", "tile", "value", "error")


@plans.query(f"""with {_TILED_SQL}, k as (select id, case when v < 15 then 'low' when v < 35 then 'middle' else 'high' end cls, i from win), m as (select id, cls from (select id, cls, count(*) n, min(i) f from k group by 1, 2) qualify row_number() over (partition by id order by n desc, f) = 1)
select ok.id as point_id, m.cls as class, (select max(v) - min(v) from win where win.id = ok.id) as relief from ok left join m using (id)""")
def tile_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent class and relief of the cells around every place."""
    classes = lambda v: F.when(v < 15, "low").when(v < 35, "middle").otherwise("high")
    w = F.col("window")
    return _sampler(1).sample(*_tiles(spark, folder)).select("point_id", window_class(w, classes).alias("class"), window_relief(w).alias("relief"))


# null models


@plans.query(f"""with {POINTS_SQL}, {_REDRAW_SQL}, ac as (select id, min(greatest(abs(mk.x - pt.x), abs(mk.y - pt.y))) k from pt, mk group by 1)
select 'near a market' as metric, 'mean of redraws' as basis, (select round(avg(pct), 4) from g) as value, (select round(quantile_cont(pct, 0.025), 4) from g) as lo95, (select round(quantile_cont(pct, 0.975), 4) from g) as hi95
union all select 'near a market, first draw', 'single draw', (select round(pct, 4) from g where draw = 0), null, null
union all select 'near a market, as built', 'count', (select round(100.0 * count(*) filter (where k <= {NEAR}) / count(*), 4) from ac), null, null""")
def published_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """The published figures with what each is based on: a mean with its envelope where it was redrawn, else a single draw."""
    drawn = _redraws(spark, folder)
    points = in_cells(coops(spark, folder))
    near = rings.with_ring(points, rings.nearest_ring(points, in_cells(markets(spark, folder)), NEAR))
    none = F.lit(None).cast("double")
    row = lambda df, metric, basis, value: df.select(F.lit(metric).alias("metric"), F.lit(basis).alias("basis"), F.round(value, 4).alias("value"), none.alias("lo95"), none.alias("hi95"))
    mean = stats.envelope(drawn, [], "pct").select(F.lit("near a market").alias("metric"), F.lit("mean of redraws").alias("basis"), F.col("mean").alias("value"), "lo95", "hi95")
    built = near.agg((100.0 * F.count("k") / F.count(F.lit(1))).alias("pct"))
    return mean.unionByName(row(drawn.where("draw = 0"), "near a market, first draw", "single draw", F.col("pct"))).unionByName(row(built, "near a market, as built", "count", F.col("pct")))


# files


@plans.query(_FIGURES_SQL + " select key, round(computed, 4) as computed, rendered from r where status = 'pass'")
def figure_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The figures that passed, written as a file of one record a line and read again."""
    path = _place(spark, "figures")
    figures.run(spark, folder).where("status = 'pass'").select("key", F.round("computed", 4).alias("computed"), "rendered").write.json(path)
    return spark.read.schema("key string, computed double, rendered string").json(path)


_AREA_PAGES_SQL = f"""{VILLAGES_SQL}, ar as (select {_F.format('province')} p, {_F.format('district')} d, count(*) n from v where province is not null and district is not null group by 1, 2),
pages as (select p as page, '<html><h1>' || p || '</h1><table>' || string_agg('<tr><td>' || d || '</td><td>' || n || '</td></tr>', '' order by d) || '</table></html>' as html from ar group by 1)"""


def _area_pages(spark: SparkSession, folder: str) -> DataFrame:
    ar = villages(spark, folder, "province", "district").where("province is not null and district is not null").groupBy(folded("province").alias("page"), folded("district").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("d", "n")))  # the districts of a province: an administrative list
    cells = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<tr><td>"), r["d"], F.lit("</td><td>"), r["n"].cast("string"), F.lit("</td></tr>"))), "")
    return ar.groupBy("page").agg(rows.alias("rows")).select("page", F.concat(F.lit("<html><h1>"), F.col("page"), F.lit("</h1><table>"), cells, F.lit("</table></html>")).alias("html"))


@plans.query(f"with {_AREA_PAGES_SQL} select * from pages")
def area_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page of HTML for every province with a table of its districts."""
    return _area_pages(spark, folder)


@plans.query(f"with {_AREA_PAGES_SQL} select page, length(html) as n_chars, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """The pages written as files, a folder of drafts left out, and read again as text without tags."""
    path, pages = _place(spark, "pages"), _area_pages(spark, folder)
    sinks.write_pages(pages, f"{path}/site")
    sinks.write_pages(pages.withColumn("html", F.lit("draft")), f"{path}/drafts")
    read = files.read_site(spark, path, ["/drafts/"])
    return read.select("page", F.length("html").alias("n_chars"), X.strip_tags(F.col("html")).alias("text"))


_LINK_PAGES_SQL = """pg as (select 'areas/' || n_nationkey || '/index.html' as page, n_nationkey k from nation), ln as (select page, 'areas/' || ((k + 1) % 30) || '/index.html' as target from pg union all select page, 'areas/' || k || '/map.png' from pg)"""


@plans.query(f"with {_LINK_PAGES_SQL} select page, target from ln where target not in (select page from pg)")
def broken_links_in_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as files, read again and searched for links that lead to no page."""
    path = _place(spark, "linked-pages")
    sinks.write_pages(_links(spark, folder)[0], path)
    pages = files.read_site(spark, path)
    urls = pages.select("page", F.explode(X.links(F.col("html"))).alias("url")).where(~X.is_external(F.col("url")))
    return urls.select("page", X.resolved(F.col("page"), F.col("url")).alias("target")).join(pages.select(F.col("page").alias("target")), "target", "left_anti").select("page", "target")


@plans.query(_FIGURES_SQL + """, q as (select 'nation-' || n_nationkey || '.html' as page, 'provinces_listed' as key, (36 + n_nationkey % 4)::varchar as quoted from nation union all select 'nation-' || n_nationkey || '.html', 'no_such_figure', '7' from nation where n_nationkey % 5 = 0)
select page, q.key, quoted, case when r.rendered is null then 'unknown' when quoted = rendered then 'ok' else 'stale' end as status from q left join r on q.key = r.key and r.status = 'pass'""")
def quotes_in_files(spark: SparkSession, folder: str) -> DataFrame:
    """Figures quoted in page files against the registry of those that passed."""
    k = F.col("n_nationkey")
    html = F.concat(F.lit('<p><b data-figure="provinces_listed">'), (36 + k % 4).cast("string"), F.lit("</b></p>"), F.when(k % 5 == 0, '<i data-figure="no_such_figure">7</i>').otherwise(""))
    path = _place(spark, "quoting-pages")
    sinks.write_pages(table(spark, folder, "nation").select(F.concat(F.lit("nation-"), k.cast("string"), F.lit(".html")).alias("page"), html.alias("html")), path)
    pages = files.read_site(spark, path)
    return quoted_figures(pages, figures.run(spark, folder))


@plans.query("select s_suppkey, s_name, s_acctbal from supplier where s_suppkey % 10 <> 3")
def decrypted_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records sent as AES-256 in CBC mode with padding, base64 encoded; damaged ones are left out as rejects."""
    key = "0123456789abcdef0123456789abcdef"
    json = F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal"))
    sent = table(spark, folder, "supplier").select(F.base64(F.aes_encrypt(json, F.lit(key), F.lit("CBC"), F.lit("PKCS"))).alias("payload"), "s_suppkey")
    damaged = sent.select(F.when(F.col("s_suppkey") % 10 == 3, F.substring("payload", 1, 17)).otherwise(F.col("payload")).alias("payload"))
    good, _ = files.decrypted(damaged, "payload", key, "s_suppkey bigint, s_name string, s_acctbal double")
    return good


_SCRIPT_SQL = """sc as (select n_nationkey k, '// "not this"' || chr(10) || 'const a' || n_nationkey || ' = "' || n_name || '"; /* ''nor this'' */' || chr(10) || 'call(''it\\''s ' || n_nationkey || ''', `x ${a}`);' as script from nation)"""


@plans.query(f"with {_SCRIPT_SQL} select k as n_nationkey, unnest(['\"' || n_name || '\"', '''it\\''s ' || k || '''', '`x ${{a}}`']) as literal from sc join nation on k = n_nationkey")
def script_literals(spark: SparkSession, folder: str) -> DataFrame:
    """The string literals of scripts; what stands in comments isn't one."""
    k = F.col("n_nationkey")
    script = F.concat(F.lit('// "not this"\nconst a'), k.cast("string"), F.lit(' = "'), F.col("n_name"), F.lit("\"; /* 'nor this' */\ncall('it\\'s "), k.cast("string"), F.lit("', `x ${a}`);"))
    return table(spark, folder, "nation").select("n_nationkey", F.explode(X.string_literals(script)).alias("literal"))


_LAYER_SQL = "ly as (select distinct osm_id, lower(class) as class, ring from landuse_features where osm_type in ('way', 'relation') and len(ring) > 2)"


def _layer(spark: SparkSession, folder: str) -> str:
    rows = table(spark, folder, "landuse_features").where(F.col("osm_type").isin("way", "relation") & (F.size("ring") > 2)).select("osm_id", F.lower("class").alias("class"), F.lit("polygon").alias("kind"), "ring").distinct()
    path = f"{_local(shared_folder(spark))}/layer-{uuid.uuid4().hex}.gpkg"
    geopackage.write_geopackage(rows, path, "landuse")
    return path


@plans.query(f"with {_LAYER_SQL} select osm_id, class, 'polygon' as kind, len(ring)::integer as n_points, ring[1].x as x, ring[1].y as y from ly")
def geopackage_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A layer written to a GeoPackage and read in ranges of row numbers, geometries included."""
    df = geopackage.read_geopackage(spark, _layer(spark, folder), "landuse", {"osm_id": "bigint", "class": "string"}, "geom", chunk=500)
    first = F.col("parts")[0]
    return df.select("osm_id", "class", "kind", F.size(first).alias("n_points"), first[0]["x"].alias("x"), first[0]["y"].alias("y"))


@plans.query(f"with {_LAYER_SQL} select class, count(*) as n from ly group by 1")
def geopackage_table(spark: SparkSession, folder: str) -> DataFrame:
    """A layer without its geometries, kept as parquet."""
    path = _place(spark, "layer-cache")
    geopackage.read_geopackage(spark, _layer(spark, folder), "landuse", {"osm_id": "bigint", "class": "string"}, chunk=500).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@plans.query(f"with {_LAYER_SQL} select osm_id from ly where len(list_filter(ring, lambda p: p.x between 100 and 120 and p.y between -6 and 2)) > 0")
def geopackage_window(spark: SparkSession, folder: str) -> DataFrame:
    """The features of a layer with a point in a window."""
    return geopackage.read_geopackage(spark, _layer(spark, folder), "landuse", {"osm_id": "bigint"}, "geom", box=(100.0, -6.0, 120.0, 2.0), chunk=500).select("osm_id")


_OSM_SQL = "w as (select osm_id, lower(trim(class)) as class, ring from (select distinct osm_id, class, ring from landuse_features where osm_type = 'way' and len(ring) > 2 and class is not null) qualify row_number() over (partition by osm_id order by class, ring) = 1)"


def _extract(spark: SparkSession, folder: str) -> DataFrame:
    """The ways of the land use table as an extract: each vertex is a node, each way has its class as a tag."""
    w = table(spark, folder, "landuse_features").where((F.col("osm_type") == "way") & (F.size("ring") > 2) & F.col("class").isNotNull()).select("osm_id", "class", "ring").distinct()
    w = w.groupBy("osm_id").agg(F.min(F.struct("class", "ring")).alias("b")).select("osm_id", F.lower(F.trim("b.class")).alias("class"), "b.ring")
    node = lambda i: F.col("osm_id") * 10_000 + i
    road = F.get(F.array(*[F.lit(r) for r in osm.ROADS]), (F.col("osm_id") % 20).cast("int"))
    tags = F.map_filter(F.create_map(F.lit("landuse"), F.col("class"), F.lit("highway"), road), lambda _, v: v.isNotNull())
    ways = w.select(F.lit("way").alias("kind"), F.col("osm_id").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), tags.alias("tags"), F.transform(F.sequence(F.lit(0), F.size("ring") - 1), node).alias("refs"))
    nodes = w.select("osm_id", F.posexplode("ring").alias("i", "p")).select(F.lit("node").alias("kind"), node(F.col("i")).alias("id"), F.col("p.y").alias("lat"), F.col("p.x").alias("lon"), F.create_map().cast("map<string, string>").alias("tags"), F.lit(None).cast("array<bigint>").alias("refs"))
    path = f"{_local(shared_folder(spark))}/extract-{uuid.uuid4().hex}.osm.pbf"
    osm.write_osm(nodes.unionByName(ways), path)
    return osm.read_osm(spark, path)


@plans.query(f"with {_OSM_SQL} select osm_id as id, class, len(ring)::integer as n_points, round(list_sum(list_transform(ring, lambda p: round(p.x * 10000000))) / 10000000, 5) as sum_x, round(list_sum(list_transform(ring, lambda p: round(p.y * 10000000))) / 10000000, 5) as sum_y from w where class in ('cemetery', 'farmland', 'residential', 'forest')")
def osm_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Ways of some classes from an extract, assembled from their nodes."""
    e = _extract(spark, folder)
    ways = e.where((F.col("kind") == "way") & F.col("tags")["landuse"].isin("cemetery", "farmland", "residential", "forest"))
    total = lambda axis: F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + F.round(p[axis] * 10_000_000)) / 10_000_000, 5)
    return osm.lines(e, ways).select("id", F.col("tags")["landuse"].alias("class"), F.size("ring").alias("n_points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@plans.query(f"with {_OSM_SQL}, r as (select {osm.ROADS}[1 + osm_id % 20] as highway from w) select highway, count(*) as n from r where highway is not null group by 1")
def osm_roads(spark: SparkSession, folder: str) -> DataFrame:
    """Roads of an extract by class: ways with one of the sixteen classes."""
    highway = F.col("tags")["highway"]
    return _extract(spark, folder).where((F.col("kind") == "way") & highway.isin(osm.ROADS)).groupBy(highway.alias("highway")).agg(F.count(F.lit(1)).alias("n"))


@plans.query("select s_suppkey, s_acctbal, true as zstd from supplier")
def zstd_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "zstd")
    table(spark, folder, "supplier").select("s_suppkey", "s_acctbal").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).withColumn("zstd", F.col("_metadata.file_name").endswith(".zstd.parquet"))


@plans.query(f"with {POINTS_SQL} select id as point_id, lon as xmin from pt where lat > -3")
def nested_projection(spark: SparkSession, folder: str) -> DataFrame:
    """One field of a struct of bounds and a filter on another: the scan reads those two alone."""
    path = _place(spark, "bounds")
    bounds = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lon") + 1).alias("xmax"), (F.col("lat") + 1).alias("ymax"))
    coops(spark, folder).select("point_id", bounds.alias("bbox"), F.lit("unread").alias("other")).write.parquet(path)
    return spark.read.parquet(path).where(F.col("bbox.ymin") > -3).select("point_id", F.col("bbox.xmin").alias("xmin"))


@plans.query("select sha256(string_agg(r_name || chr(10), '' order by r_regionkey)) as sha256, sum(strlen(r_name) + 1)::bigint as bytes from region")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Size and hash of a written file's bytes, as the manifest gives them."""
    path = _place(spark, "content")
    table(spark, folder, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path, lineSep="\n")
    return files.file_manifest(spark, path, "part-*").select("sha256", "bytes")


@plans.query("select c_custkey, sha256(c_name) as sha256, lower(hex(c_name)) as hex, base64(c_name::blob) as base64 from customer")
def encodings(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, folder, "customer").select("c_custkey", F.sha2(name, 256).alias("sha256"), F.lower(F.hex(F.encode(name, "UTF-8"))).alias("hex"), F.base64(F.encode(name, "UTF-8")).alias("base64"))


@plans.query(f"with {POINTS_SQL} select id as point_id, floor(lon * 10000) / 10000 as lon, floor(lat * 10000) / 10000 as lat, c and true as in_cemetery, case when c then province end as province from pt")
def compact_file(spark: SparkSession, folder: str) -> DataFrame:
    """Points as compact lines [lon,lat,flags], with further data for flagged ones only, written, read and decoded."""
    path = _place(spark, "compact")
    p = coops(spark, folder)
    flags = F.when(F.col("in_cemetery").isNull(), 2).when(F.col("in_cemetery"), 1).otherwise(0)
    point = sinks.compact_points(F.floor(F.col("lat") * 10_000) / 10_000, F.floor(F.col("lon") * 10_000) / 10_000, flags)
    p.select("point_id", point.alias("p"), F.when(F.col("in_cemetery"), F.struct("province")).alias("meta")).write.json(path)
    raw = spark.read.schema("point_id bigint, p string, meta struct<province: string>").json(path)
    return raw.select("point_id", *files.decoded_point(F.col("p")), F.col("meta.province").alias("province")).select("point_id", "lon", "lat", F.when(F.col("flags").bitwiseAND(2) == 0, F.col("flags").bitwiseAND(1) == 1).alias("in_cemetery"), "province")


@plans.query("select count(*) as n, count(distinct id) as n_ids from (select c_custkey id from customer where c_custkey % 10 = 0 union all select id from (select c_custkey id, ((c_custkey * 7919) % 2200000 - 1100000) / 100000 lat, (9500000 + (c_custkey * 104729) % 4600000) / 100000 lon from customer where c_custkey % 10 <> 0) where lat between -11 and 6 and lon between 95 and 141 and 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat + 2.5) / 2), 2) + cos(radians(-2.5)) * cos(radians(lat)) * pow(sin(radians(lon - 118) / 2), 2)))) <= 2000000)")
def registry_file(spark: SparkSession, folder: str) -> DataFrame:
    """A registry kept as files to which accepted corrections are appended twice: the second time adds nothing."""
    path = _place(spark, "registry")
    accepted = _corrections(spark, folder)[0].select("id")
    table(spark, folder, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id")).write.parquet(path)
    for _ in range(2):
        sinks.append_to(spark, path, accepted, "id")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@plans.query("""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') l from documents),
e as (select doc_id, unnest(l) s, unnest(range(1, len(l) + 1)) i from s), c as (select doc_id, s, i, sum(length(s) + 1) over (partition by doc_id order by i) upto from e)
select doc_id, s as sentence from c where upto > 200 and upto - length(s) - 1 <= 200""")
def sentence_at_offset(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence that holds the 200th character of a text, blanks made single."""
    return table(spark, folder, "documents").select("doc_id", X.sentence_at(F.col("text"), 200).alias("sentence")).where("sentence is not null")


@plans.query("select n_nationkey, n_name as name, r_name as region_name, r_regionkey as region_key from nation join region on n_regionkey = r_regionkey")
def flatten_one_level(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a nested record, flattened by one level with the outer field's name before the inner one."""
    r = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")).alias("region"))
    nested = table(spark, folder, "nation").join(r, "n_regionkey").select("n_nationkey", F.col("n_name").alias("name"), "region")
    return files.flatten_level(nested)


QUERIES, ORACLE = plans.queries, plans.oracle
