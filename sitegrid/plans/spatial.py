"""Cells, rings, nearest neighbours, polygons and clusters over the registry's coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions.bands import band_histogram, right_closed, threshold_band
from sitegrid.functions.geo import geodesic_m, haversine_m, valid_point
from sitegrid.operators import clusters, grid, knn, polygons, profile, rings
from sitegrid.operators.dedup import latest_by
from sitegrid.operators.measures import rollup_levels
from sitegrid.operators.proximity import in_regions, near_points
from sitegrid.operators.ranks import with_quantiles
from sitegrid.operators.stars import folded
from sitegrid.plans.registry import Plans
from sitegrid.sources.tables import table

plans = Plans()
CAP = 38
#: Kilometres between rings of the finest cells.
RING_KM = 5.566
BAND_BOUNDS = [(0, "same cell"), (2, "within 2"), (8, "within 8"), (20, "within 20"), (CAP, "within 38")]
BAND_ORDER = [*[b for _, b in BAND_BOUNDS], "none found"]


def coops(spark: SparkSession, folder: str) -> DataFrame:
    """``point_id, province, lat, lon, in_cemetery`` of the cooperatives with a valid coordinate at their latest screening."""
    rows = table(spark, folder, "cemetery_candidates").where("cooperative_id is not null").select("cooperative_id", "screened_at", "latitude", "longitude", "province", "in_cemetery", "dist_village_m")
    last = latest_by(rows, ["cooperative_id"], "screened_at").where(valid_point(F.col("latitude"), F.col("longitude")))
    return last.select(F.col("cooperative_id").alias("point_id"), folded("province").alias("province"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "in_cemetery", "dist_village_m")


def in_cells(df: DataFrame, level: int = 0) -> DataFrame:
    x, y = grid.axes(grid.micro(F.col("lat")), grid.micro(F.col("lon")), level)
    return df.withColumns({"x": x, "y": y})


def markets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "landuse_features").where((F.lower("class") == "marketplace") & (F.col("osm_type") == "node") & valid_point(F.col("latitude"), F.col("longitude")))
    return rows.select(F.col("osm_id").alias("target_id"), "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Land assets as weights of 1: the places people chose."""
    rows = table(spark, folder, "land_assets").where(valid_point(F.col("latitude"), F.col("longitude")))
    return rows.select("asset_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct().withColumn("w", F.lit(1))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "landuse_features").where(F.col("osm_type").isin("way", "relation") & F.col("ring").isNotNull())
    return rows.select(F.col("osm_id").alias("region_id"), F.lower("class").alias("class"), "ring").distinct()


_CELLS = "(cast(floor({lo} * 1000000) as bigint) + 180000000) // 50000 as x, (cast(floor({la} * 1000000) as bigint) + 90000000) // 50000 as y"
POINTS_SQL = (
    "co as (select cooperative_id id, arg_max(struct_pack(lat := latitude, lon := longitude, p := upper(trim(regexp_replace(province, '\\s+', ' ', 'g'))), c := in_cemetery, v := dist_village_m), screened_at) r from cemetery_candidates group by 1), "
    "pt as (select id, r.p province, r.lat lat, r.lon lon, r.c c, r.v v, " + _CELLS.format(la="r.lat", lo="r.lon") + " from co where r.lat between -90 and 90 and r.lon between -180 and 180)"
)
MARKETS_SQL = "mk as (select distinct osm_id, name, latitude lat, longitude lon, " + _CELLS.format(la="latitude", lo="longitude") + " from landuse_features where lower(class) = 'marketplace' and osm_type = 'node' and latitude between -90 and 90 and longitude between -180 and 180)"
ASSETS_SQL = "la as (select distinct asset_id, latitude lat, longitude lon, " + _CELLS.format(la="latitude", lo="longitude") + " from land_assets where latitude between -90 and 90 and longitude between -180 and 180)"
REGIONS_SQL = "rg as (select distinct osm_id, lower(class) as class, ring from landuse_features where osm_type in ('way', 'relation') and ring is not null), ed as (select osm_id, class, ring, ring[i].x x1, ring[i].y y1, ring[i % len(ring) + 1].x x2, ring[i % len(ring) + 1].y y2 from (select *, unnest(range(1, len(ring) + 1)) i from rg))"
_METRES = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
INSIDE_SQL = "ins as (select pt.id, lat, lon, osm_id, class, ring from pt join ed on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 group by all having count(*) % 2 = 1)"




_MORTON = "list_reduce(list_transform(range(0, 31), lambda i: (((x >> i) & 1) << (2 * i)) | (((y >> i) & 1) << (2 * i + 1))), lambda a, b: a | b)"


@plans.query(f"with {POINTS_SQL} select id as point_id, x, y, {_MORTON} as cell, lpad(lower(to_hex({_MORTON})), 16, '0') as hex, {_MORTON} >> 4 as grandparent from pt")
def cells_assign(spark: SparkSession, folder: str) -> DataFrame:
    cell = grid.cell_id(F.col("x"), F.col("y"))
    return in_cells(coops(spark, folder)).select("point_id", "x", "y", cell.alias("cell"), grid.hex_id(cell).alias("hex"), grid.parent(cell, 2).alias("grandparent"))


@plans.query(f"with {POINTS_SQL}, {MARKETS_SQL}, p as (select x // 16 px, y // 16 py, count(*) n from pt group by 1, 2), m as (select x // 16 px, y // 16 py, count(*) n from mk group by 1, 2) select px, py, p.n as n_points, m.n as n_markets from p join m using (px, py)")
def cell_parent_join(spark: SparkSession, folder: str) -> DataFrame:
    """Points and markets joined by the parent cell four levels up."""
    sides = []
    for df, name in ((coops(spark, folder), "n_points"), (markets(spark, folder), "n_markets")):
        cell = grid.parent(grid.cell_id(F.col("x"), F.col("y")), 4)
        sides.append(in_cells(df).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias(name)))
    px, py = grid.cell_xy(F.col("cell"))
    return sides[0].join(sides[1], "cell").select(px.alias("px"), py.alias("py"), "n_points", "n_markets")


@plans.query(f"with {POINTS_SQL} select distinct x, y, y * 50000 + 25000 - 90000000 as lat_e6, x * 50000 + 25000 - 180000000 as lon_e6, (x * 50000 - 180000000) / 1000000.0::double as west, ((y + 1) * 50000 - 90000000) / 1000000.0::double as north from pt")
def cell_centres(spark: SparkSession, folder: str) -> DataFrame:
    cell = grid.cell_id(F.col("x"), F.col("y"))
    lat, lon = grid.centre(cell)
    ring = grid.corners(cell)
    return in_cells(coops(spark, folder)).select("x", "y", lat.alias("lat_e6"), lon.alias("lon_e6"), ring[0]["x"].alias("west"), ring[2]["y"].alias("north")).distinct()


_NEAREST_SQL = f"{POINTS_SQL}, {MARKETS_SQL}, nr as (select id, province, min(greatest(abs(mk.x - pt.x), abs(mk.y - pt.y))) filter (where greatest(abs(mk.x - pt.x), abs(mk.y - pt.y)) <= {CAP}) k from pt, mk group by 1, 2)"


def _rings(spark: SparkSession, folder: str) -> DataFrame:
    points = in_cells(coops(spark, folder))
    return rings.with_ring(points, rings.nearest_ring(points, in_cells(markets(spark, folder)), CAP))


@plans.query(f"with {_NEAREST_SQL} select id as point_id, cast(k as integer) as k, round(k::double * {RING_KM}, 3) as km from nr")
def ring_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return _rings(spark, folder).select("point_id", "k", F.round(F.col("k") * RING_KM, 3).alias("km"))


_BAND_CASE = "case when k is null then 'none found' " + " ".join(f"when k <= {b} then '{name}'" for b, name in BAND_BOUNDS) + " end"


@plans.query(f"with {_NEAREST_SQL}, d(ord, band) as (values {', '.join(f'''({i + 1}, '{b}')''' for i, b in enumerate(BAND_ORDER))}), b as (select {_BAND_CASE} band from nr) select ord, d.band, count(b.band) as n, round(100.0 * count(b.band) / sum(count(b.band)) over (), 2) as pct from d left join b on d.band = b.band group by 1, 2")
def ring_bands(spark: SparkSession, folder: str) -> DataFrame:
    return band_histogram(_rings(spark, folder).withColumn("band", threshold_band(F.col("k"), BAND_BOUNDS, "none found", "none found")), "band", BAND_ORDER)


@plans.query(f"""with {POINTS_SQL}, {MARKETS_SQL}, c as (select distinct x, y from pt), d as (select c.x, c.y, greatest(abs(mk.x - c.x), abs(mk.y - c.y)) k, osm_id % 2 = 0 even from c, mk)
select x, y, min(k) filter (where k <= 12) as k, min(k) filter (where k <= 12 and even) as k_even from d group by 1, 2""")
def ring_conditional(spark: SparkSession, folder: str) -> DataFrame:
    out = rings.ring_minima(in_cells(coops(spark, folder)), in_cells(markets(spark, folder)), 12, {"k_even": F.col("target_id") % 2 == 0})
    return out.select("x", "y", F.col("k").cast("bigint").alias("k"), F.col("k_even").cast("bigint").alias("k_even"))


@plans.query(f"""with {POINTS_SQL}, {MARKETS_SQL}, c as (select distinct x, y from pt), d as (select c.x, c.y, greatest(abs(mk.x - c.x), abs(mk.y - c.y)) k, coalesce(name, '?') label from c, mk)
select x, y, k, label from (select x, y, k, min(label) as label from d where k <= 20 group by 1, 2, 3 union all select x, y, null, null from c where not exists (select 1 from d where d.x = c.x and d.y = c.y and k <= 20)) qualify row_number() over (partition by x, y order by k) = 1""")
def label_transfer(spark: SparkSession, folder: str) -> DataFrame:
    """The name of a market in the nearest ring that has one."""
    found = rings.nearest_ring(in_cells(coops(spark, folder)), in_cells(markets(spark, folder)), 20, {"label": F.min(F.coalesce("name", F.lit("?")))})
    return found.select("x", "y", F.col("k").cast("bigint").alias("k"), "label")


@plans.query(f"""with {POINTS_SQL}, {ASSETS_SQL}, p as (select distinct x, y from pt), w as (select x, y, count(*) w from la group by 1, 2), ks(k) as (values (0), (1), (3)),
u as (select distinct k, p.x + dx as x, p.y + dy as y from p, ks, range(-3, 4) a(dx), range(-3, 4) b(dy) where greatest(abs(dx), abs(dy)) <= k)
select k, count(*) as cells, cast(coalesce(sum(w), 0) as bigint) as covered from u left join w using (x, y) group by 1""")
def coverage_union(spark: SparkSession, folder: str) -> DataFrame:
    points, weights = in_cells(coops(spark, folder)), in_cells(assets(spark, folder))
    out = None
    for k in (0, 1, 3):
        one = rings.union_coverage(points, weights, k)
        out = one if out is None else out.unionByName(one)
    return out


@plans.query(f"with {POINTS_SQL}, {ASSETS_SQL}, p as (select distinct x, y from pt) select p.x, p.y, count(la.asset_id) as within_2 from p left join la on abs(la.x - p.x) <= 2 and abs(la.y - p.y) <= 2 group by 1, 2")
def catchment_sum(spark: SparkSession, folder: str) -> DataFrame:
    return rings.catchments(in_cells(coops(spark, folder)), in_cells(assets(spark, folder)), 2, "within_2")


@plans.query("""with r as (select distinct osm_id, lower(class) as class, ring from landuse_features where osm_type = 'way' and len(ring) > 2), g as (select osm_id, class, ring, unnest(range(1, len(ring))) j from r),
l as (select osm_id, class, cast(floor(ring[j].y * 1000000) as bigint) a1, cast(floor(ring[j].x * 1000000) as bigint) o1, cast(floor(ring[j + 1].y * 1000000) as bigint) a2, cast(floor(ring[j + 1].x * 1000000) as bigint) o2 from g), n as (select *, greatest(1, cast(ceil(greatest(abs(a2 - a1), abs(o2 - o1)) / 100) as bigint)) n from l),
s as (select osm_id, class, a1 + cast(floor((a2 - a1) * i / n) as bigint) la, o1 + cast(floor((o2 - o1) * i / n) as bigint) lo from (select *, unnest(range(0, n + 1)) i from n))
select distinct osm_id as line_id, class, (lo + 180000000) // 500 as x, (la + 90000000) // 500 as y from s""")
def line_rasterise(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of about 55 m met by the line of each way, from vertex to vertex, with the way's class."""
    ways = table(spark, folder, "landuse_features").where((F.col("osm_type") == "way") & (F.size("ring") > 2)).select(F.struct("osm_id", F.lower("class").alias("class")).alias("line_id"), "ring").distinct()
    n = F.size("ring") - 1
    whole = lambda p, axis: grid.micro(p[axis])
    legs = F.zip_with(F.slice("ring", F.lit(1), n), F.slice("ring", F.lit(2), n), lambda a, b: F.struct(whole(a, "y").alias("lat1"), whole(a, "x").alias("lon1"), whole(b, "y").alias("lat2"), whole(b, "x").alias("lon2")))
    x, y = grid.cell_xy(F.col("cell"))
    return grid.rasterised(ways.select("line_id", F.inline(legs)), 100, base=500).select(F.col("line_id.osm_id").alias("line_id"), "line_id.class", x.alias("x"), y.alias("y"))


_NN_SQL = f"{POINTS_SQL}, {MARKETS_SQL}, nn as (select pt.id, osm_id, round({_METRES.format(a='pt', b='mk')}, 1) m from pt, mk qualify row_number() over (partition by pt.id order by m, osm_id) = 1)"


def _to_market(spark: SparkSession, folder: str) -> DataFrame:
    return knn.nearest(coops(spark, folder).select("point_id", "lat", "lon"), markets(spark, folder).select("target_id", "lat", "lon"))


@plans.query(f"with {_NN_SQL} select id as point_id, osm_id as target_id, m as distance_m from nn")
def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _to_market(spark, folder)


@plans.query(f"with {POINTS_SQL}, b as (select id as bid, lat, lon from pt), nn as (select pt.id, bid, round({_METRES.format(a='pt', b='b')}, 1) m from pt, b where pt.id <> bid qualify row_number() over (partition by pt.id order by m, bid) = 1) select id as point_id, bid as target_id, m as distance_m from nn")
def knn_self(spark: SparkSession, folder: str) -> DataFrame:
    p = coops(spark, folder).select("point_id", "lat", "lon")
    return knn.nearest(p, p.withColumnRenamed("point_id", "target_id"), self_join=True)


@plans.query(f"with {_NN_SQL} select t as threshold, count(*) filter (where m <= t) as n, round(100.0 * count(*) filter (where m <= t) / count(*), 2) as pct from nn, (values (10000.0::double), (50000.0::double), (100000.0::double), (200000.0::double)) v(t) group by 1")
def within_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return profile.within_thresholds(_to_market(spark, folder), F.col("distance_m"), [10_000, 50_000, 100_000, 200_000])


@plans.query("""with e as (select vec_id, embedding::double[] v from embeddings), d as (select a.vec_id, b.vec_id other, round(list_dot_product(a.v, b.v), 9) c from e a, e b where a.vec_id <> b.vec_id and a.vec_id % 100 = 0)
select vec_id, other as nearest_id, round(acos(least(1, greatest(-1, c))), 4) as arc from d qualify row_number() over (partition by vec_id order by c desc, other) = 1""")
def knn_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other vector of every vector whose id is divisible by 100, among all vectors."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return knn.nearest_vectors(vectors.where(F.col("vec_id") % 100 == 0), vectors)


@plans.query(f"with {POINTS_SQL}, {MARKETS_SQL} select pt.id as point_id, osm_id as place_id, round({_METRES.format(a='pt', b='mk')}, 1) as distance_m from pt, mk where {_METRES.format(a='pt', b='mk')} <= 30000")
def radius_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_points(coops(spark, folder).select("point_id", "lat", "lon"), markets(spark, folder).select(F.col("target_id").alias("place_id"), "lat", "lon"), 30_000.0).withColumn("distance_m", F.round("distance_m", 1))


@plans.query(f"""with {POINTS_SQL}, c as (select x // 4 cx, y // 4 cy, count(*) n from pt group by 1, 2) select cast(sum(n) as bigint) as entities, count(*) filter (where n > 1) as shared_cells, cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) as entities_sharing, max(n) as most_in_a_cell, round(100.0 * coalesce(sum(n) filter (where n > 1), 0) / sum(n), 2) as pct_sharing from c""")
def colocation(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.colocation(in_cells(coops(spark, folder), 2), ["x", "y"])


@plans.query(f"with {POINTS_SQL} select lat, lon, count(*) as n from pt group by 1, 2 having count(*) > 1")
def duplicate_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.repeated_coordinates(coops(spark, folder))


_SIZE_LABELS = ["1", "2-5", "6-20", "21+"]
_COMPONENTS_SQL = f"""recursive {POINTS_SQL}, c as (select distinct x // 4 x, y // 4 y from pt), ids as (select x, y, x * 2147483648 + y as id from c), e as (select a.id, b.id as other from ids a join ids b on abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2),
walk as (select id, id as other from ids union select walk.id, e.other from walk join e on walk.other = e.id), comp as (select id, min(other) component from walk group by 1), cc as (select x, y, component from ids join comp using (id))"""


def _components(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.components(in_cells(coops(spark, folder), 2), 2)


@plans.query(f"with {_COMPONENTS_SQL} select x, y, component from cc")
def components(spark: SparkSession, folder: str) -> DataFrame:
    return _components(spark, folder)


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cooperatives with the component of their cell."""
    return in_cells(coops(spark, folder), 2).join(_components(spark, folder), ["x", "y"])


@plans.query(f"with {_COMPONENTS_SQL}, m as (select pt.*, component from pt join cc on pt.x // 4 = cc.x and pt.y // 4 = cc.y) select component, count(*) as members, count(distinct struct_pack(a := x // 4, b := y // 4)) as cells, count(distinct province) as provinces, min(id) as first_member from m group by 1 having count(*) > 1")
def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    g = _clusters(spark, folder).groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("x", "y").alias("cells"), F.count_distinct("province").alias("provinces"), F.min("point_id").alias("first_member"))
    return g.where("members > 1")


@plans.query(f"""with {_COMPONENTS_SQL}, m as (select component, count(*) n from pt join cc on pt.x // 4 = cc.x and pt.y // 4 = cc.y group by 1), b as (select case when n <= 1 then '1' when n <= 5 then '2-5' when n <= 20 then '6-20' else '21+' end band from m),
d(ord, band) as (values (1, '1'), (2, '2-5'), (3, '6-20'), (4, '21+')) select ord, d.band, count(b.band) as n, round(100.0 * count(b.band) / sum(count(b.band)) over (), 2) as pct from d left join b on d.band = b.band group by 1, 2""")
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _clusters(spark, folder).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return band_histogram(sizes.withColumn("band", right_closed(F.col("n"), [0, 1, 5, 20, 10**12], _SIZE_LABELS)), "band", _SIZE_LABELS)


@plans.query(f"""with {POINTS_SQL}, c as (select *, count(*) over (partition by x // 4, y // 4) > 1 as shared from pt), g as (select case when shared then 'clustered' else 'isolated' end grp, c inc, v from c)
select 'group' as level, grp as key, count(*) as n, round(100.0 * count(*) filter (where inc) / nullif(count(inc), 0), 2) as pct_in_cemetery, round(median(v), 4) as median_m from g group by grp union all select 'all', 'all', count(*), round(100.0 * count(*) filter (where inc) / nullif(count(inc), 0), 2), round(median(v), 4) from g""")
def clustered_vs_isolated(spark: SparkSession, folder: str) -> DataFrame:
    p = in_cells(coops(spark, folder), 2)
    counts = p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    labelled = p.join(counts, ["x", "y"]).withColumn("grp", F.when(F.col("n") > 1, "clustered").otherwise("isolated"))
    inside = F.col("in_cemetery")
    out = rollup_levels(labelled, {"group": ["grp"], "all": []}, [F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(inside) / F.nullif(F.count(inside), F.lit(0)), 2).alias("pct_in_cemetery")])
    each = labelled.select("dist_village_m", F.explode(F.array(F.col("grp"), F.lit("all"))).alias("key"))
    return with_quantiles(out, each, ["key"], {"median_m": (F.col("dist_village_m"), 0.5)})


@plans.query(f"with {POINTS_SQL}, {REGIONS_SQL}, {INSIDE_SQL} select distinct id as point_id, osm_id as region_id, class from ins")
def pip_join(spark: SparkSession, folder: str) -> DataFrame:
    r = regions(spark, folder)
    found = in_regions(coops(spark, folder).select("point_id", "lat", "lon"), r.select("region_id", "ring"))
    return found.distinct().join(r.select("region_id", "class").distinct(), "region_id").select("point_id", "region_id", "class")


@plans.query(f"""with {POINTS_SQL}, {REGIONS_SQL}, {INSIDE_SQL}, j as (select pt.id, c, v, exists (select 1 from ins where ins.id = pt.id and class in ('cemetery', 'grave_yard')) inside from pt)
select unnest([1, 2, 3]) as step, unnest(['located', 'inside a burial ground', 'recorded as inside']) as label, unnest([count(*), count(*) filter (where inside), count(*) filter (where inside and c)]) as n from j""")
def pip_funnel(spark: SparkSession, folder: str) -> DataFrame:
    p, r = coops(spark, folder), regions(spark, folder).where(F.col("class").isin("cemetery", "grave_yard"))
    hits = in_regions(p.select("point_id", "lat", "lon"), r.select("region_id", "ring")).select("point_id", F.lit(True).alias("inside")).distinct()
    return profile.funnel(p.join(hits, "point_id", "left"), [("located", F.lit(True)), ("inside a burial ground", F.col("inside")), ("recorded as inside", F.col("in_cemetery"))])


@plans.query(f"""with {POINTS_SQL}, {REGIONS_SQL}, {INSIDE_SQL}, g as (select ins.id, ins.osm_id, ins.lat, ins.lon, (x1 - ins.lon) * cos(radians(ins.lat)) ax, y1 - ins.lat ay, (x2 - ins.lon) * cos(radians(ins.lat)) bx, y2 - ins.lat "by" from ins join ed on ins.osm_id = ed.osm_id and ins.ring = ed.ring),
t as (select *, least(greatest(coalesce(-(ax * (bx - ax) + ay * ("by" - ay)) / nullif((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay), 0), 0), 0), 1) t from g)
select id as point_id, osm_id as region_id, round(min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * ("by" - ay), 2))) * (pi() * 6371000 / 180), 1) as depth_m from t group by 1, 2""")
def pip_depth(spark: SparkSession, folder: str) -> DataFrame:
    return polygons.depths(coops(spark, folder).select("point_id", "lat", "lon"), regions(spark, folder).select("region_id", "ring").distinct())


@plans.query(f"""with {POINTS_SQL}, {REGIONS_SQL}, {INSIDE_SQL}, a as (select osm_id, ring, round(abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6371000.0 * 6371000.0 / 2, 0) area from ed group by 1, 2), n as (select osm_id, count(*) n from ins group by 1)
select osm_id as region_id, len(ring) as n_points, area as area_m2, coalesce(n, 0) as n_inside from a left join n using (osm_id)""")
def polygon_quality(spark: SparkSession, folder: str) -> DataFrame:
    q = polygons.quality(regions(spark, folder).select("region_id", "ring"), coops(spark, folder).select("point_id", "lat", "lon"))
    return q.withColumn("n_points", F.col("n_points").cast("bigint"))


# each part of a ring is cut at its farthest vertex until none is farther than the tolerance; a ring starts as two parts
_SIMPLE_SQL = """with recursive rg as (select row_number() over () n, osm_id, ring from (select distinct osm_id, lower(class) class, ring from landuse_features where osm_type in ('way', 'relation') and len(ring) > 2)),
op as (select n, osm_id, ring, unnest(range(1, len(ring) + 1)) i from rg), p0 as (select n, osm_id, i, ring[i].x x, ring[i].y y from op),
pt as (select * from p0 union all select n, osm_id, len(ring) + 1, ring[1].x, ring[1].y from rg where ring[1].x <> ring[len(ring)].x or ring[1].y <> ring[len(ring)].y),
ends as (select n, max(i) z, arg_min(x, i) x1, arg_min(y, i) y1 from pt group by 1),
half as (select pt.n, i h, z from pt join ends using (n) qualify row_number() over (partition by pt.n order by sqrt(pow(x - x1, 2) + pow(y - y1, 2)) desc, i) = 1),
seg(n, a, b) as (
  select n, unnest([1, h]), unnest([h, z]) from half
  union all
  select n, unnest([a, i]), unnest([i, b]) from (
    select n, a, b, arg_min(i, i) filter (where away = most) i from (
      select *, max(away) over (partition by n, a, b) most from (
        select s.n, s.a, s.b, p.i, case when f.x = t.x and f.y = t.y then sqrt(pow(p.x - f.x, 2) + pow(p.y - f.y, 2)) else abs((t.x - f.x) * (p.y - f.y) - (t.y - f.y) * (p.x - f.x)) / sqrt(pow(t.x - f.x, 2) + pow(t.y - f.y, 2)) end away
        from seg s join pt p on p.n = s.n and p.i > s.a and p.i < s.b join pt f on f.n = s.n and f.i = s.a join pt t on t.n = s.n and t.i = s.b))
    where most > 0.0002 group by 1, 2, 3)),
kept as (select distinct n, i from (select n, a i from seg union all select n, b from seg))
select osm_id as region_id, count(*)::integer as n_points, sum(cast(round(x * 10000000) as bigint))::bigint as x_e7, sum(cast(round(y * 10000000) as bigint))::bigint as y_e7 from kept join pt using (n, i) group by n, osm_id having count(*) >= 4"""


@plans.query(_SIMPLE_SQL)
def polygon_simplify(spark: SparkSession, folder: str) -> DataFrame:
    """Rings with fewer points: how many are left, and the sums of their coordinates in ten-millionths of a degree."""
    total = lambda axis: F.aggregate("ring", F.lit(0).cast("bigint"), lambda s, p: s + F.round(p[axis] * 10_000_000).cast("bigint"))
    simple = polygons.simplified(regions(spark, folder).select("region_id", "ring"), 0.0002, digits=9)
    return simple.select("region_id", F.size("ring").alias("n_points"), total("x").alias("x_e7"), total("y").alias("y_e7"))


@plans.query(f"""with {_NN_SQL}, r as (select pt.id, min(greatest(abs(mk.x - pt.x), abs(mk.y - pt.y))) k from pt, mk group by 1), e as (select k * {RING_KM} * 1000 - m as e from r join nn using (id) where k <= {CAP})
select count(*) as n, round(median(e), 4) as median_error, round(median(abs(e)), 4) as median_abs_error, round(quantile_cont(abs(e), 0.9), 4) as p90_abs_error, round(100.0 * count(*) filter (where abs(e) <= 5000) / nullif(count(*), 0), 2) as pct_within from e""")
def ring_vs_exact(spark: SparkSession, folder: str) -> DataFrame:
    both = _rings(spark, folder).select("point_id", "k").join(_to_market(spark, folder), "point_id")
    return profile.error_stats(both, F.col("k") * RING_KM * 1000, F.col("distance_m"), 5000.0)


@plans.query("""with l as (select cooperative_id, arg_max(struct_pack(a := lat_2026_08_05, o := lon_2026_08_05, b := lat_2026_08_17, q := lon_2026_08_17), received_at) r from corrected_coordinates_2026_08 group by 1)
select cooperative_id, case when r.a is null or r.o is null or r.b is null or r.q is null then 'missing' when abs(r.a - r.b) <= 0.00001 and abs(r.o - r.q) <= 0.00001 then 'same' when abs(r.a + r.b) <= 0.00001 and abs(r.o - r.q) <= 0.00001 then 'latitude sign flipped' when abs(r.a - r.q) <= 0.00001 and abs(r.o - r.b) <= 0.00001 then 'swapped' else 'moved' end as diagnosis,
coalesce(not (r.a between -11 and 6 and r.o between 95 and 141), true) as outside from l""")
def suspect_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corrected_coordinates_2026_08").select("cooperative_id", "received_at", "lat_2026_08_05", "lon_2026_08_05", "lat_2026_08_17", "lon_2026_08_17")
    last = latest_by(rows, ["cooperative_id"], "received_at")
    a, o, b, q = (F.col(c) for c in ("lat_2026_08_05", "lon_2026_08_05", "lat_2026_08_17", "lon_2026_08_17"))
    close = lambda x, y: F.abs(x - y) <= 0.00001
    diagnosis = F.when(a.isNull() | o.isNull() | b.isNull() | q.isNull(), "missing").when(close(a, b) & close(o, q), "same").when(close(a, -b) & close(o, q), "latitude sign flipped").when(close(a, q) & close(o, b), "swapped").otherwise("moved")
    return last.select("cooperative_id", diagnosis.alias("diagnosis"), F.coalesce(~(a.between(-11, 6) & o.between(95, 141)), F.lit(True)).alias("outside"))


@plans.query(f"with {POINTS_SQL} select cast(floor((lon + 180) * 8) as bigint) as sx, cast(floor((90 - lat) * 8) as bigint) as sy, count(*) as n, round(100.0 * count(*) filter (where c) / nullif(count(c), 0), 2) as pct_in_cemetery from pt group by 1, 2")
def screen_grid(spark: SparkSession, folder: str) -> DataFrame:
    inside = F.col("in_cemetery")
    return coops(spark, folder).groupBy(F.floor((F.col("lon") + 180) * 8).alias("sx"), F.floor((90 - F.col("lat")) * 8).alias("sy")).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(inside) / F.nullif(F.count(inside), F.lit(0)), 2).alias("pct_in_cemetery"))


@plans.query(f"with {REGIONS_SQL} select osm_id as line_id, round(sum(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))), 1) as length_m from ed group by osm_id, ring")
def polyline_length(spark: SparkSession, folder: str) -> DataFrame:
    """Length around each ring, the closing leg included."""
    ring = F.col("ring")
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    legs = F.zip_with(ring, after, lambda a, b: haversine_m(a["y"], a["x"], b["y"], b["x"]))
    return regions(spark, folder).select(F.col("region_id").alias("line_id"), F.round(F.aggregate(legs, F.lit(0.0), lambda s, d: s + d), 1).alias("length_m"))


# Vincenty's inverse formula (1975), repeated for all pairs until the longitude on the auxiliary sphere settles
_GEODESIC_SQL = f"""with recursive {_NN_SQL}, k(f, a) as (values (1 / 298.257223563::double, 6378137.0::double)),
ends as (select nn.id, nn.osm_id, atan((1 - f) * tan(radians(pt.lat))) u1, atan((1 - f) * tan(radians(mk.lat))) u2, radians(mk.lon - pt.lon) l, f from nn join pt using (id) join (select distinct osm_id, lat, lon from mk) mk using (osm_id), k),
it(id, osm_id, u1, u2, l, f, lam, moved, i) as (
  select id, osm_id, u1, u2, l, f, l, 1.0::double, 0 from ends
  union all
  select id, osm_id, u1, u2, l, f, following, abs(following - lam), i + 1 from (
    select *, l + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))) following from (
      select *, f / 16 * c2 * (4 + f * (4 - 3 * c2)) c from (
        select *, case when c2 = 0 then 0 else cs - 2 * sin(u1) * sin(u2) / c2 end cm from (
          select *, 1 - sa * sa c2 from (
            select *, case when ss = 0 then 0 else cos(u1) * cos(u2) * sin(lam) / ss end sa, atan2(ss, cs) sigma from (
              select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) cs from it where moved >= 1e-12 and i < 60))))))),
last as (select * from it qualify row_number() over (partition by id, osm_id order by i desc) = 1),
v as (select id, osm_id, ss, cs, sigma, case when c2 = 0 then 0 else cs - 2 * sin(u1) * sin(u2) / c2 end cm, c2 * (1 / pow(1 - f, 2) - 1) u, (1 - f) * (select a from k) b from (select *, 1 - pow(case when ss = 0 then 0 else cos(u1) * cos(u2) * sin(lam) / ss end, 2) c2, atan2(ss, cs) sigma from (select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) cs from last))),
w as (select *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) aa, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) bb from v)
select id as point_id, osm_id as target_id, round(b * aa * (sigma - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 2) as geodesic_m from w"""


@plans.query(_GEODESIC_SQL)
def geodesic_inverse(spark: SparkSession, folder: str) -> DataFrame:
    """Distance on the spheroid from each cooperative to its nearest market."""
    near = _to_market(spark, folder).drop("distance_m")
    p, m = coops(spark, folder).select("point_id", "lat", "lon"), markets(spark, folder).select("target_id", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    return near.join(p, "point_id").join(m, "target_id").select("point_id", "target_id", F.round(geodesic_m("lat", "lon", "mlat", "mlon"), 2).alias("geodesic_m"))


@plans.query(f"with {POINTS_SQL} select province, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as members from pt where lat between -11 and 6 and lon between 95 and 141 group by 1")
def area_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the members, suspect coordinates left out."""
    fine = coops(spark, folder).where(F.col("lat").between(-11, 6) & F.col("lon").between(95, 141))
    return fine.groupBy("province").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count(F.lit(1)).alias("members"))


@plans.query(f"""with {POINTS_SQL}, {MARKETS_SQL}, {ASSETS_SQL}, q(name, lat, lon) as (values ('A', -6.2::double, 106.8::double), ('B', -7.25::double, 112.75::double)), c as (select *, (cast(floor(lon * 1000000) as bigint) + 180000000) // 50000 x, (cast(floor(lat * 1000000) as bigint) + 90000000) // 50000 y from q)
select name, (select min(greatest(abs(mk.x - c.x), abs(mk.y - c.y))) from mk where greatest(abs(mk.x - c.x), abs(mk.y - c.y)) <= {CAP}) as market_ring, (select count(*) from la where greatest(abs(la.x - c.x), abs(la.y - c.y)) <= 10) as assets_within_10, (select count(*) from pt where greatest(abs(pt.x - c.x), abs(pt.y - c.y)) <= 10) as coops_within_10 from c""")
def point_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Measures at two given places, A against B."""
    places = in_cells(spark.createDataFrame([("A", -6.2, 106.8), ("B", -7.25, 112.75)], "name string, lat double, lon double"))
    ring = rings.nearest_ring(places, in_cells(markets(spark, folder)), CAP)
    near_assets = rings.catchments(places, in_cells(assets(spark, folder)), 10, "assets_within_10")
    near_coops = rings.catchments(places, in_cells(coops(spark, folder).withColumn("w", F.lit(1))), 10, "coops_within_10")
    out = places.join(ring, ["x", "y"], "left").join(near_assets, ["x", "y"]).join(near_coops, ["x", "y"])
    return out.select("name", F.col("k").cast("bigint").alias("market_ring"), "assets_within_10", "coops_within_10")


QUERIES, ORACLE = plans.queries, plans.oracle
