"""The registry's own data problems: histories, snapshot changes, orphan references and places near points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.operators.history import attribute_history, snapshots_of
from sitegrid.operators.proximity import in_regions, near_points
from sitegrid.operators.references import Reference, orphan_counts, orphan_rows
from sitegrid.operators.snapshots import snapshot_changes, with_values
from sitegrid.sources.tables import table

#: Days on which full snapshots were delivered.
SNAPSHOT_DATES = ["2026-08-05", "2026-08-09", "2026-08-13", "2026-08-17"]
#: A coordinate that differs by no more is the same (degrees).
SAME_DEGREES = 0.00001
#: A cooperative this near to a burial ground given as a point is reported (metres).
NEAR_M = 400.0
BURIAL = ["cemetery", "grave_yard"]


def coordinate_history(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "corrected_coordinates_2026_08")
    columns = [(d, [f"lat_{d.replace('-', '_')}", f"lon_{d.replace('-', '_')}"]) for d in SNAPSHOT_DATES]
    rows = snapshots_of(df, "cooperative_id", "received_at", columns, ["latitude", "longitude"])
    return attribute_history(rows, "cooperative_id", "snapshot", ["latitude", "longitude"], SAME_DEGREES)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return coordinate_history(spark, folder).select("cooperative_id", "valid_from", "valid_to")


def p2_history(spark: SparkSession, folder: str) -> DataFrame:
    return coordinate_history(spark, folder)


def _village_changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, folder, "stats_village")
    return df, snapshot_changes(df, "village_id", "snapshot_date", "loaded_at", ["transaction_value"], SNAPSHOT_DATES)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _village_changes(spark, folder)[1]


def p3_changes(spark: SparkSession, folder: str) -> DataFrame:
    df, changes = _village_changes(spark, folder)
    return with_values(changes, df, "village_id", "snapshot_date", "loaded_at", ["transaction_value"])


def _references(spark: SparkSession, folder: str) -> list[Reference]:
    return [
        Reference("health_index_by_province", table(spark, folder, "health_index_by_province"), "index_id", "province_id", "snapshot_date", "stats_province", table(spark, folder, "stats_province"), "province_id", "snapshot_date"),
        Reference("snapshot_diff_changed_villages", table(spark, folder, "snapshot_diff_changed_villages"), "diff_id", "village_id", "t1", "stats_village", table(spark, folder, "stats_village"), "village_id", "snapshot_date"),
    ]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_rows(_references(spark, folder))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_references(spark, folder))


def _burial_grounds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = table(spark, folder, "cemetery_candidates").where("cooperative_id is not null").select(F.col("cooperative_id").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    grounds = table(spark, folder, "landuse_features").where(F.lower(F.trim("class")).isin(BURIAL) & F.col("osm_id").isNotNull())
    nodes = grounds.where("osm_type = 'node'").select(F.col("osm_id").alias("place_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    areas = grounds.where("osm_type in ('way', 'relation')").select(F.col("osm_id").alias("region_id"), "ring").distinct()
    return points, nodes, areas


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    points, nodes, areas = _burial_grounds(spark, folder)
    near = near_points(points, nodes, NEAR_M).select(F.col("point_id").alias("cooperative_id"), F.col("place_id").alias("osm_id"))
    inside = in_regions(points, areas, NEAR_M).select(F.col("point_id").alias("cooperative_id"), F.col("region_id").alias("osm_id"))
    return near.union(inside).distinct()


def p6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest burial ground given as a point, with its distance."""
    points, nodes, _ = _burial_grounds(spark, folder)
    best = F.min(F.struct(F.round("distance_m", 1).alias("distance_m"), "place_id")).alias("best")
    return near_points(points, nodes, NEAR_M).groupBy(F.col("point_id").alias("cooperative_id")).agg(best).select("cooperative_id", F.col("best.place_id").alias("osm_id"), F.col("best.distance_m").alias("distance_m"))


QUERIES = {f.__name__: f for f in (p2_found, p2_history, p3_found, p3_changes, p4_found, p4_report, p6_found, p6_nearest)}

_HISTORY = """
with long as (
  %s
), latest as (
  select cooperative_id, snapshot, arg_max(struct_pack(lat := lat, lon := lon), received_at) p from long where lat is not null and lon is not null group by all
), before as (
  select cooperative_id, snapshot, p.lat lat, p.lon lon, lag(p.lat) over w plat, lag(p.lon) over w plon from latest window w as (partition by cooperative_id order by snapshot)
), starts as (
  select * from before where plat is null or abs(lat - plat) > 0.00001 or abs(lon - plon) > 0.00001
)
select cooperative_id, %s snapshot as valid_from, coalesce(lead(snapshot) over (partition by cooperative_id order by snapshot), '9999-12-31') as valid_to from starts
"""
_LONG = "\n  union all ".join(f"select cooperative_id, received_at, '{d}' snapshot, lat_{d.replace('-', '_')} lat, lon_{d.replace('-', '_')} lon from corrected_coordinates_2026_08" for d in SNAPSHOT_DATES)
_CHANGES = """
with latest as (
  select village_id, snapshot_date, transaction_value from stats_village where village_id is not null
  qualify row_number() over (partition by village_id, snapshot_date order by loaded_at desc, transaction_value desc nulls last) = 1
), pairs(t0, t1) as (values ('2026-08-05', '2026-08-09'), ('2026-08-09', '2026-08-13'), ('2026-08-13', '2026-08-17')),
a as (select village_id, t0, t1, transaction_value v0 from latest join pairs on snapshot_date = t0::date),
b as (select village_id, t0, t1, transaction_value v1 from latest join pairs on snapshot_date = t1::date)
select coalesce(a.village_id, b.village_id) as village_id, coalesce(a.t0, b.t0) as t0, coalesce(a.t1, b.t1) as t1,
  case when a.village_id is null then 'added' when b.village_id is null then 'removed' else 'changed' end as change %s
from a full join b on a.village_id = b.village_id and a.t0 = b.t0
where a.village_id is null or b.village_id is null or v0 is distinct from v1
"""
_ORPHANS = """
with orphans as (
  select distinct 'health_index_by_province' as table_name, 'stats_province' as parent_table, strftime(snapshot_date, '%Y-%m-%d') as period, index_id as row_id, province_id as key
  from health_index_by_province h where province_id is not null and not exists (select 1 from stats_province s where s.province_id = h.province_id and s.snapshot_date = h.snapshot_date)
  union all
  select distinct 'snapshot_diff_changed_villages', 'stats_village', strftime(t1, '%Y-%m-%d'), diff_id, village_id
  from snapshot_diff_changed_villages d where village_id is not null and not exists (select 1 from stats_village s where s.village_id = d.village_id and s.snapshot_date = d.t1)
)
"""
_GROUNDS = """
with points as (select distinct cooperative_id, latitude lat, longitude lon from cemetery_candidates where latitude between -90 and 90 and longitude between -180 and 180),
grounds as (select * from landuse_features where lower(class) in ('cemetery', 'grave_yard')),
near as (
  select cooperative_id, osm_id, 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2)))) as m
  from points, grounds where osm_type = 'node' and abs(latitude - lat) < 0.01
),
edges as (
  select distinct osm_id, ring, i, ring[i].x x1, ring[i].y y1, ring[i % len(ring) + 1].x x2, ring[i % len(ring) + 1].y y2
  from (select osm_id, ring, unnest(range(1, len(ring) + 1)) i from grounds where osm_type in ('way', 'relation'))
)
"""
ORACLE = {
    "p2_found": _HISTORY % (_LONG, ""),
    "p2_history": _HISTORY % (_LONG, "row_number() over (partition by cooperative_id order by snapshot) as version, lat as latitude, lon as longitude,"),
    "p3_found": _CHANGES % "",
    "p3_changes": _CHANGES % ", v0 as transaction_value_t0, v1 as transaction_value_t1",
    "p4_found": _ORPHANS + "select distinct table_name, period, row_id from orphans",
    "p4_report": """
with rows_of as (
  select 'health_index_by_province' as table_name, 'stats_province' as parent_table, strftime(snapshot_date, '%Y-%m-%d') as period, province_id as key
  from health_index_by_province h where province_id is not null and not exists (select 1 from stats_province s where s.province_id = h.province_id and s.snapshot_date = h.snapshot_date)
  union all
  select 'snapshot_diff_changed_villages', 'stats_village', strftime(t1, '%Y-%m-%d'), village_id
  from snapshot_diff_changed_villages d where village_id is not null and not exists (select 1 from stats_village s where s.village_id = d.village_id and s.snapshot_date = d.t1)
) select table_name, parent_table, period, count(*) as orphan_rows, count(distinct key) as orphan_keys from rows_of group by all""",
    "p6_found": _GROUNDS + """
select cooperative_id, osm_id from near where m <= 400
union
select cooperative_id, osm_id from points p join edges e on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1
group by cooperative_id, lat, lon, osm_id, ring having count(*) % 2 = 1""",
    "p6_nearest": _GROUNDS + """
select cooperative_id, osm_id, m as distance_m from (select cooperative_id, osm_id, round(m, 1) m from near where m <= 400)
qualify row_number() over (partition by cooperative_id order by m, osm_id) = 1""",
}
