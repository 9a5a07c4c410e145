"""Smaller operators: interval bands, flags, extents, similar names, deltas, layouts, nested records, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrid.functions.bands import half_open, ramp, recode
from sitegrid.functions.similarity import block_bound, block_similarity
from sitegrid.operators import grid, rasters
from sitegrid.operators.profile import long_form
from sitegrid.operators.stars import folded
from sitegrid.operators.stats import places_nulls_last, uniform
from sitegrid.plans.profiles import MONEY, VILLAGES_SQL, villages
from sitegrid.plans.registry import Plans
from sitegrid.plans.rollups import _DAY_SQL, _day
from sitegrid.plans.spatial import MARKETS_SQL, POINTS_SQL, coops, in_cells, markets
from sitegrid.sources import files
from sitegrid.sources.tables import table

plans = Plans()
ELEVATION = [(0.0, 2000.0, "0-2k"), (2000.0, 5000.0, "2k-5k"), (5000.0, 1e9, "5k+")]


@plans.query("select case when c_acctbal >= 0 and c_acctbal < 2000 then '0-2k' when c_acctbal >= 2000 and c_acctbal < 5000 then '2k-5k' when c_acctbal >= 5000 then '5k+' end as band, count(*) as n from customer group by 1")
def half_open_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Balances below the first bound have no band, not the last one."""
    return table(spark, folder, "customer").groupBy(half_open(F.col("c_acctbal"), ELEVATION).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@plans.query(f"""with {VILLAGES_SQL}, f as (select (transaction_value is null)::int a, (coalesce(npwp_count, 0) = 0)::int b, (coalesce(rat_count, 0) = 0)::int c from v)
select a + b + c as n_flags, count(*) as n, cast(sum(a) as bigint) as unlinked, cast(sum(b) as bigint) as no_tax_number, cast(sum(c) as bigint) as no_meeting from f group by 1""")
def flag_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Flags added up per row, and per flag among rows with as many."""
    v = villages(spark, folder, "transaction_value", "npwp_count", "rat_count")
    flags = {"unlinked": F.col("transaction_value").isNull(), "no_tax_number": F.coalesce("npwp_count", F.lit(0)) == 0, "no_meeting": F.coalesce("rat_count", F.lit(0)) == 0}
    marked = v.select(*[f.cast("int").alias(k) for k, f in flags.items()])
    total = sum((F.col(k) for k in flags), F.lit(0))
    return marked.groupBy(total.alias("n_flags")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in flags])


@plans.query(f"with {POINTS_SQL} select province, case when min(lat) = max(lat) then min(lat) - 0.5 else min(lat) end as south, case when min(lat) = max(lat) then max(lat) + 0.5 else max(lat) end as north, round(least(greatest((avg(lon) - 95) / (141 - 95), 0), 1), 6) as place from pt group by 1")
def extents(spark: SparkSession, folder: str) -> DataFrame:
    """Least and greatest latitude of each province, widened where they are one, and its place from west to east."""
    g = coops(spark, folder).groupBy("province").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.avg("lon").alias("m"))
    one = F.col("a") == F.col("b")
    return g.select("province", F.when(one, F.col("a") - 0.5).otherwise(F.col("a")).alias("south"), F.when(one, F.col("b") + 0.5).otherwise(F.col("b")).alias("north"), F.round(ramp(F.col("m"), 95.0, 141.0), 6).alias("place"))


@plans.query()
def similar_districts(spark: SparkSession, folder: str) -> DataFrame:
    """Typed district names with the most similar listed one of their province, at 0.82 or more by matching blocks."""
    listed = villages(spark, folder, "province", "district").select(folded("province").alias("p"), folded("district").alias("listed")).dropna().distinct()
    typed = table(spark, folder, "land_assets").select(folded("province").alias("p"), folded("district").alias("typed")).dropna().distinct()
    unknown = typed.join(listed.withColumnRenamed("listed", "typed"), ["p", "typed"], "left_anti")
    near = unknown.join(listed, "p").where((F.length("typed") > 0) & (block_bound(F.col("typed"), F.col("listed")) >= 0.8199))
    scored = near.withColumn("similarity", F.round(block_similarity("typed", "listed"), 4)).where("similarity >= 0.82")
    return scored.groupBy("p", "typed").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "listed")).alias("b")).select(F.col("p").alias("province"), "typed", F.col("b.listed").alias("listed"), (-F.col("b.s")).alias("similarity"))


@plans.query(f"""with a as {_DAY_SQL.format('2026-08-05')}, b as {_DAY_SQL.format('2026-08-17')} select case when a.transaction_value is null and b.transaction_value is null then 'unknown' when a.transaction_value is null then 'appeared' when b.transaction_value is null then 'gone' when a.transaction_value = b.transaction_value then 'same' else 'moved' end as delta,
(coalesce(a.transaction_value, 0) > 0) <> (coalesce(b.transaction_value, 0) > 0) as crosses, count(*) as n from a join b using (village_id) group by 1, 2""")
def delta_classes(spark: SparkSession, folder: str) -> DataFrame:
    """How a value differs between two states, and whether it crosses zero."""
    a, b = (_day(spark, folder, d).select("village_id", F.col("transaction_value").alias(n)) for d, n in (("2026-08-05", "a"), ("2026-08-17", "b")))
    x, y = F.col("a"), F.col("b")
    delta = F.when(x.isNull() & y.isNull(), "unknown").when(x.isNull(), "appeared").when(y.isNull(), "gone").when(x == y, "same").otherwise("moved")
    crosses = (F.coalesce(x, F.lit(0)) > 0) != (F.coalesce(y, F.lit(0)) > 0)
    return a.join(b, "village_id").groupBy(delta.alias("delta"), crosses.alias("crosses")).agg(F.count(F.lit(1)).alias("n"))


@plans.query("select n_nationkey, 'lat=' || n_nationkey || '&lon=' || (n_nationkey * 2) || '&mode=a' as hash, n_nationkey::varchar as lat, (n_nationkey * 2)::varchar as lon, cast(null as varchar) as zoom from nation")
def hash_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters kept in a link's fragment, written and parsed; a missing one is null."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("lat="), k.cast("string"), F.lit("&lon="), (k * 2).cast("string"), F.lit("&mode=a"))
    parsed = F.str_to_map("hash", F.lit("&"), F.lit("="))
    return table(spark, folder, "nation").select("n_nationkey", text.alias("hash")).select("n_nationkey", "hash", *[F.try_element_at(parsed, F.lit(n)).alias(n) for n in ("lat", "lon", "zoom")])


@plans.query(f"with {POINTS_SQL} select distinct 2 * x + dx as x, 2 * y + dy as y from pt, range(0, 2) a(dx), range(0, 2) b(dy)")
def cell_children(spark: SparkSession, folder: str) -> DataFrame:
    """The four children of each occupied cell; their parent is that cell."""
    cells = in_cells(coops(spark, folder)).select(grid.cell_id(F.col("x"), F.col("y")).alias("cell")).distinct()
    child = cells.select("cell", F.explode(grid.children(F.col("cell"))).alias("child")).where(grid.parent(F.col("child")) == F.col("cell"))
    x, y = grid.cell_xy(F.col("child"))
    return child.select(x.alias("x"), y.alias("y"))


@plans.query(f"with {POINTS_SQL} select id as point_id, 2 * x + ((((((id * 1103515245 + 12345) % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647) % 4) & 1) as x, 2 * y + (((((id * 1103515245 + 12345) % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647) % 4 >> 1) as y from pt")
def random_child(spark: SparkSession, folder: str) -> DataFrame:
    """A repeatable random child of each point's cell."""
    p = in_cells(coops(spark, folder)).withColumn("n", F.pmod(uniform(F.col("point_id"), 0), F.lit(4)))
    child = F.shiftleft(grid.cell_id(F.col("x"), F.col("y")), 2).bitwiseOR(F.col("n").cast("bigint"))
    x, y = grid.cell_xy(child)
    return p.select("point_id", x.alias("x"), y.alias("y"))


@plans.query(f"with {VILLAGES_SQL}, t as (select province_id, count(*) n from v group by 1) select province_id, (row_number() over (order by province_id) - 1) // 8 as row, (row_number() over (order by province_id) - 1) % 8 as col, n from t")
def cartogram_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Provinces on a grid eight wide, in the order of their ids (a few rows)."""
    t = villages(spark, folder, "province_id").groupBy("province_id").agg(F.count(F.lit(1)).alias("n"))
    at = (F.row_number().over(Window.partitionBy().orderBy("province_id")) - 1).cast("bigint")
    return t.select("province_id", F.floor(at / 8).alias("row"), (at % 8).alias("col"), "n")


@plans.query("""with s as (select s_suppkey, case when s_suppkey % 9 = 0 then null else s_acctbal end v from supplier), r as (select s_suppkey, row_number() over (order by v nulls last, s_suppkey) up, row_number() over (order by v desc nulls last, s_suppkey) down from s)
select 'up' as direction, up as place, s_suppkey from r union all select 'down', down, s_suppkey from r""")
def nulls_last_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every row in both directions: nulls come last in either."""
    s = table(spark, folder, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("v"))
    return places_nulls_last(s, "v", "s_suppkey").unpivot(["s_suppkey"], ["up", "down"], "direction", "place").select("direction", "place", "s_suppkey")


@plans.query("select osm_id as id, name, 'shop' as key, lower(class) as class from (select distinct osm_id, name, class from landuse_features where osm_type = 'node' and name is not null)")
def overpass_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of a JSON answer with tags as a map, made rows."""
    nodes = table(spark, folder, "landuse_features").where("osm_type = 'node' and name is not null").select("osm_id", "name", "class").distinct()
    element = F.struct(F.lit("node").alias("type"), F.col("osm_id").alias("id"), F.create_map(F.lit("name"), F.col("name"), F.lit("shop"), F.lower("class")).alias("tags"))
    answers = nodes.groupBy(F.floor(F.col("osm_id") / 64).alias("part")).agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("json"))
    parsed = answers.select(F.explode(F.from_json("json", "elements array<struct<type: string, id: bigint, tags: map<string, string>>>")["elements"]).alias("e"))
    return parsed.select("e.id", F.col("e.tags")["name"].alias("name"), F.lit("shop").alias("key"), F.col("e.tags")["shop"].alias("class"))


@plans.query("select 'events_' || event_type as metric, count(*)::varchar as value from events group by event_type")
def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return files.metric_rows(one, "m", "events_")


@plans.query("select n_nationkey, n_name as detail_name, n_regionkey as detail_region from nation")
def struct_flatten(spark: SparkSession, folder: str) -> DataFrame:
    nested = table(spark, folder, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s"))
    return files.flatten_struct(nested, "s", "detail_")


_CLASS_SQL = "case when v < -0.05 then 'low' when v < 0.05 then 'flat' else 'high' end"


def _majority_sql(name: str, reach: int) -> str:
    n = 2 * reach + 1
    return f"{name} as (select vec_id, cls from (select vec_id, cls, count(*) n, min(i) f from (select vec_id, i, {_CLASS_SQL} cls from (select vec_id, i, embedding[({3 - reach} + i // {n}) * 8 + {4 - reach} + i % {n} + 1]::double v from embeddings, range(0, {n * n}) t(i))) group by 1, 2) qualify row_number() over (partition by vec_id order by n desc, f) = 1)"


def _majorities(spark: SparkSession, folder: str, reach: int) -> DataFrame:
    v = F.col("v")
    cells = rasters.window_values(table(spark, folder, "embeddings"), "vec_id", "embedding", 8, 3, 4, reach)
    return rasters.majority(cells.withColumn("class", F.when(v < -0.05, "low").when(v < 0.05, "flat").otherwise("high")), "vec_id", "class")


@plans.query(f"with {_majority_sql('a', 1)}, {_majority_sql('b', 2)} select a.cls as narrow, b.cls as wide, count(*) as n from a join b using (vec_id) group by 1, 2")
def window_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """How the class of a place depends on the window's size."""
    a = _majorities(spark, folder, 1).select("vec_id", F.col("class").alias("narrow"))
    b = _majorities(spark, folder, 2).select("vec_id", F.col("class").alias("wide"))
    return a.join(b, "vec_id").groupBy("narrow", "wide").agg(F.count(F.lit(1)).alias("n"))


@plans.query(f"with {_majority_sql('a', 1)}, {_majority_sql('b', 1)} select count(*) as n, round(100.0 * count(*) filter (where a.cls = b.cls) / count(*), 2) as agreement from a join b using (vec_id)")
def sampler_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Two samplers of one raster must agree: a sampled window, and the whole raster filtered to it."""
    a = _majorities(spark, folder, 1).select("vec_id", F.col("class").alias("x"))
    whole = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    v = F.col("e").cast("double")
    inside = whole.where(F.floor(F.col("p") / 8).between(2, 4) & (F.col("p") % 8).between(3, 5))
    b = rasters.majority(inside.withColumn("class", F.when(v < -0.05, "low").when(v < 0.05, "flat").otherwise("high")), "vec_id", "class", "p").select("vec_id", F.col("class").alias("y"))
    return a.join(b, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("x") == F.col("y")) / F.count(F.lit(1)), 2).alias("agreement"))


@plans.query("""with a as (select distinct district_id from documents where district_id is not null), b as (select distinct district_id from stats_village where district_id is not null)
select 'either' as part, count(*) as n from (select * from a union select * from b) union all select 'only documents', count(*) from (select * from a except select * from b) union all select 'both', count(*) from (select * from a intersect select * from b) union all select 'all rows', (select count(*) from a) + (select count(*) from b)""")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (table(spark, folder, t).where("district_id is not null").select("district_id").distinct() for t in ("documents", "stats_village"))
    parts = {"either": a.union(b).distinct(), "only documents": a.subtract(b), "both": a.intersect(b), "all rows": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@plans.query(f"with {VILLAGES_SQL} " + " union all ".join(f"select village_id, '{m}' as field, {m}::double as value from v where {m} > 0" for m in MONEY))
def wide_to_long(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(villages(spark, folder, *MONEY), ["village_id"], MONEY).where("value > 0")


@plans.query(f"with {POINTS_SQL}, {MARKETS_SQL} select count(*) as n, (select count(distinct osm_id) from mk) as markets, count(*)::double / (select count(distinct osm_id) from mk) as per_market from pt")
def scalar_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Scalar subqueries over registered views."""
    coops(spark, folder).createOrReplaceTempView("sitegrid_points")
    markets(spark, folder).createOrReplaceTempView("sitegrid_markets")
    return spark.sql("select count(*) as n, (select count(distinct target_id) from sitegrid_markets) as markets, cast(count(*) as double) / (select count(distinct target_id) from sitegrid_markets) as per_market from sitegrid_points")


@plans.query("""with s as (select distinct village_id, (village_id * 7919 + 104729) % 1000003 h from stats_village where village_id is not null order by h, village_id limit 200), a as """ + _DAY_SQL.format("2026-08-05") + ", b as " + _DAY_SQL.format("2026-08-17") + """
select count(*) as sampled, count(*) filter (where a.village_id is not null and b.village_id is not null) as found, count(*) filter (where a.village_id is not null and b.village_id is not null and a.transaction_value is distinct from b.transaction_value) as changed from s left join a using (village_id) left join b using (village_id)""")
def sampled_requery(spark: SparkSession, folder: str) -> DataFrame:
    """A repeatable sample of 200 keys looked up in two states: the sampled drift check."""
    keys = table(spark, folder, "stats_village").where("village_id is not null").select("village_id").distinct()
    sample = keys.withColumn("h", F.pmod(F.col("village_id") * 7919 + 104729, F.lit(1000003))).orderBy("h", "village_id").limit(200)
    a, b = (_day(spark, folder, d).select("village_id", F.col("transaction_value").alias(n), F.lit(True).alias(f"has_{n}")) for d, n in (("2026-08-05", "a"), ("2026-08-17", "b")))
    both = sample.join(a, "village_id", "left").join(b, "village_id", "left")
    found = F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(found).alias("found"), F.count_if(found & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@plans.query("select c_custkey, case when c_custkey % 3 = 0 then 'yes' else 'no' end as flag, coalesce(nullif(c_mktsegment, 'FURNITURE'), 'none') as segment from customer")
def recode_and_fill_all(spark: SparkSession, folder: str) -> DataFrame:
    return _recoded(table(spark, folder, "customer"))


def _recoded(rows: DataFrame) -> DataFrame:
    cleared = rows.withColumn("segment", F.nullif("c_mktsegment", F.lit("FURNITURE"))).fillna({"segment": "none"})
    return cleared.select("c_custkey", recode((F.col("c_custkey") % 3 == 0).cast("string"), {"true": "yes", "false": "no"}).alias("flag"), "segment")


QUERIES, ORACLE = plans.queries, plans.oracle
