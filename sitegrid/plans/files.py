"""Round trips through file formats, nested documents, sorted indexes, manifests, rasters and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrid.operators import grid, rasters
from sitegrid.plans.registry import Plans
from sitegrid.plans.spatial import POINTS_SQL, coops, in_cells
from sitegrid.session import shared_folder
from sitegrid.sources import files, sinks
from sitegrid.sources.tables import table, table_or_empty
from sitegrid.streaming.registry import drained, stream_table, windowed_counts, with_late_rows, without_repeats

plans = Plans()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@plans.query("select s_suppkey, s_name, s_acctbal from supplier")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "suppliers")
    sinks.write_csv(table(spark, folder, "supplier"), path, {"table": "supplier"})
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType())])
    return files.read_csv(spark, path, schema, ["s_suppkey", "s_name", "s_acctbal"])


@plans.query("select 'good' as side, count(*) as n from supplier where s_suppkey % 10 <> 3 union all select 'damaged', count(*) from supplier where s_suppkey % 10 = 3")
def csv_damaged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose text holds an unquoted comma go to a side table."""
    path = _place(spark, "lines")
    name = F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.col("s_name"), F.lit(", Ltd"))).otherwise(F.col("s_name"))
    table(spark, folder, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), name, F.col("s_acctbal").cast("string")).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])
    good, damaged = files.read_csv_checked(spark, path, schema)
    sides = good.select(F.lit("good").alias("side")).unionByName(damaged.select(F.lit("damaged").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@plans.query("select r_name as provinces_name, n_name as districts_name, c_custkey as id from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey")
def nested_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of provinces that hold districts that hold entities, made flat; a document holds 64 ids at most."""
    c = table(spark, folder, "customer").groupBy(F.floor(F.col("c_custkey") / 64).alias("chunk"), "c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"))).alias("members"))
    n = c.join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("chunk", "n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "members")).alias("districts"))
    documents = n.join(table(spark, folder, "region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("chunk").agg(F.collect_list(F.struct(F.col("r_name").alias("name"), "districts")).alias("provinces"))
    return files.flatten_lists(documents, [("provinces", "name"), ("districts", "name"), ("members", "")], ["id"])


@plans.query("select r_name as region, n_name as nation, cast(n_nationkey as bigint) as value from region join nation on r_regionkey = n_regionkey")
def nested_maps(spark: SparkSession, folder: str) -> DataFrame:
    """A document of maps keyed by name, made flat."""
    inner = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("bigint")))).alias("m"))
    document = table(spark, folder, "region").join(inner, F.col("r_regionkey") == F.col("n_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("doc"))
    return files.flatten_maps(document, "doc", ["region", "nation"])


@plans.query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@plans.query("with k as (select event_type, count(*) n from events group by 1) select unnest(['purchase', 'click', 'refund']) as label, unnest([(select n from k where event_type = 'purchase'), (select n from k where event_type = 'click'), null]) as value")
def labelled_values(spark: SparkSession, folder: str) -> DataFrame:
    """Columns taken from a list of labels and values; a label that isn't there is null."""
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.collect_list(F.struct(F.col("event_type").alias("label"), F.col("n").alias("value"))).alias("pairs"))
    wide = one.select(*files.labelled_values(F.col("pairs"), ["purchase", "click", "refund"]))
    return wide.unpivot([], ["purchase", "click", "refund"], "label", "value")


@plans.query("select osm_id, osm_type, floor(latitude * 1000000) / 1000000 as lat, floor(longitude * 1000000) / 1000000 as lon from (select distinct osm_id, osm_type, latitude, longitude from landuse_features where osm_type = 'node')")
def geojson_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Features written as a FeatureCollection and read again."""
    nodes = table(spark, folder, "landuse_features").where("osm_type = 'node'").select("osm_id", "osm_type", "latitude", "longitude").distinct()
    feature = sinks.feature_json("Point", F.array(*[F.floor(F.col(c) * 1_000_000) / 1_000_000 for c in ("longitude", "latitude")]), ["osm_id", "osm_type"])
    path = _place(spark, "features")
    # a collection holds 64 ids at most, one collection a line
    parts = nodes.select(F.floor(F.col("osm_id") / 64).alias("part"), feature.alias("f")).groupBy("part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("f")), F.lit("]}")).alias("value"))
    parts.select("value").write.text(path, lineSep="\n")
    raw = spark.read.schema("features array<struct<properties: struct<osm_id: bigint, osm_type: string>, geometry: struct<type: string, coordinates: array<double>>>>").json(path)
    return raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))


@plans.query(f"with {POINTS_SQL}, d as (select x, y, x // 16 px, y // 16 py from pt) select x, y, count(*) as n from d where (px, py) in (select px, py from d group by 1, 2 order by count(*) desc, px, py limit 3) group by 1, 2")
def sorted_index_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Cells written sorted with their parent; a lookup by parent reads few row groups."""
    cells = in_cells(coops(spark, folder)).groupBy(grid.cell_id(F.col("x"), F.col("y")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    path = _place(spark, "index")
    sinks.write_index(cells, path, "cell", grid.parent(F.col("cell"), 4))
    index = spark.read.parquet(path)
    px, py = grid.cell_xy(F.col("p"))
    busiest = [r["p"] for r in index.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), px, py).limit(3).collect()]
    x, y = grid.cell_xy(F.col("cell"))
    return index.where(F.col("p").isin(busiest)).select(x.alias("x"), y.alias("y"), "n")


@plans.query("""select 'nation' as table_name, 'n_nationkey' as "column", 'int' as "type", count(*) as n_rows, count(n_nationkey) as n_known, count(distinct n_nationkey) as n_distinct from nation union all select 'nation', 'n_name', 'string', count(*), count(n_name), count(distinct n_name) from nation union all select 'nation', 'n_regionkey', 'int', count(*), count(n_regionkey), count(distinct n_regionkey) from nation
union all select 'region', 'r_regionkey', 'int', count(*), count(r_regionkey), count(distinct r_regionkey) from region union all select 'region', 'r_name', 'string', count(*), count(r_name), count(distinct r_name) from region
union all select 'supplier', 's_suppkey', 'bigint', count(*), count(s_suppkey), count(distinct s_suppkey) from supplier union all select 'supplier', 's_name', 'string', count(*), count(s_name), count(distinct s_name) from supplier
union all select 'supplier', 's_nationkey', 'int', count(*), count(s_nationkey), count(distinct s_nationkey) from supplier union all select 'supplier', 's_acctbal', 'double', count(*), count(s_acctbal), count(distinct s_acctbal::varchar) from supplier""")
def schema_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Columns, types and counts of three tables."""
    return reduce(DataFrame.unionByName, [sinks.table_manifest(table(spark, folder, t), t) for t in ("nation", "region", "supplier")])


@plans.query("select strftime(snapshot_date, '%Y-%m-%d') as snapshot, count(*) as n from stats_province where snapshot_date in (date '2026-08-09', date '2026-08-17') group by 1")
def snapshot_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """A table kept in a directory per snapshot; only two dates are read."""
    path = _place(spark, "snapshots")
    table(spark, folder, "stats_province").write.partitionBy("snapshot_date").parquet(path)
    df = spark.read.parquet(path).where(F.col("snapshot_date").isin("2026-08-09", "2026-08-17"))
    return df.groupBy(F.col("snapshot_date").cast("string").alias("snapshot")).agg(F.count(F.lit(1)).alias("n"))


@plans.query("select s_suppkey, cast(null as double) as rating, false as source_found from supplier")
def missing_source_standin(spark: SparkSession, folder: str) -> DataFrame:
    """A join with a table that isn't there: typed nulls, and the fact recorded."""
    ratings, there = table_or_empty(spark, folder, "supplier_ratings", T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("rating", T.DoubleType())]))
    return table(spark, folder, "supplier").select("s_suppkey").join(ratings, "s_suppkey", "left").withColumn("source_found", F.lit(there))


@plans.query("""select osm_id, round((select avg(round(p.x * 10000000)) from (select unnest(r) p)), 2) as x_e7, round((select avg(round(p.y * 10000000)) from (select unnest(r) p)), 2) as y_e7 from (select distinct osm_id, ring r from landuse_features where osm_type in ('way', 'relation') and ring is not null)""")
def vertex_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of each ring's vertices in ten-millionths of a degree: sums of whole numbers, so in any order the same."""
    rows = table(spark, folder, "landuse_features").where(F.col("osm_type").isin("way", "relation") & F.col("ring").isNotNull()).select("osm_id", "ring").distinct()
    whole = F.transform("ring", lambda p: F.struct(F.round(p["x"] * 10_000_000).alias("x"), F.round(p["y"] * 10_000_000).alias("y")))
    x, y = files.vertex_centroid(whole)
    return rows.select("osm_id", F.round(x, 2).alias("x_e7"), F.round(y, 2).alias("y_e7"))


@plans.query(f"with {POINTS_SQL} select id as point_id, case when floor(lat) < 0 then 'S' else 'N' end || lpad(abs(floor(lat)::int)::varchar, 2, '0') || case when floor(lon) < 0 then 'W' else 'E' end || lpad(abs(floor(lon)::int)::varchar, 3, '0') as tile from pt")
def tile_names(spark: SparkSession, folder: str) -> DataFrame:
    return coops(spark, folder).select("point_id", files.tile_name(F.col("lat"), F.col("lon")).alias("tile"))


_WINDOW_SQL = "v as (select vec_id, i, embedding[(2 + i // 3) * 8 + 3 + i % 3 + 1]::double as v from embeddings, range(0, 9) t(i)), c as (select vec_id, i, case when v < -0.05 then 'low' when v < 0.05 then 'flat' else 'high' end cls from v where v is not null)"


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as a raster of 8 by 8: the window of 3 by 3 around row 3, column 4."""
    return rasters.window_values(table(spark, folder, "embeddings"), "vec_id", "embedding", 8, 3, 4, 1)


@plans.query(f"with {_WINDOW_SQL}, n as (select vec_id, cls, count(*) n, min(i) f from c group by 1, 2) select vec_id, cls as class, n, round(100.0 * n / sum(n) over (partition by vec_id), 2) as pct from n qualify row_number() over (partition by vec_id order by n desc, f) = 1")
def window_majority(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    return rasters.majority(_windows(spark, folder).withColumn("class", F.when(v < -0.05, "low").when(v < 0.05, "flat").otherwise("high")), "vec_id", "class")


@plans.query(f"with {_WINDOW_SQL} select vec_id, round(max(v) - min(v), 6) as relief from v group by 1")
def window_relief(spark: SparkSession, folder: str) -> DataFrame:
    return rasters.relief(_windows(spark, folder), "vec_id")


@plans.query(f"with {POINTS_SQL} select id as point_id, '[' || format('{{:.4f}}', floor(lon * 10000) / 10000) || ',' || format('{{:.4f}}', floor(lat * 10000) / 10000) || ',' || (case when c then 1 else 0 end) || ']' as point from pt")
def compact_points(spark: SparkSession, folder: str) -> DataFrame:
    return coops(spark, folder).select("point_id", sinks.compact_points(F.floor(F.col("lat") * 10_000) / 10_000, F.floor(F.col("lon") * 10_000) / 10_000, F.when(F.col("in_cemetery"), 1).otherwise(0)).alias("point"))


@plans.query("select distinct event_id, user_id, event_type from events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream, each once whatever is delivered again."""
    stream = without_repeats(stream_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type"), ["event_id"], "ts")
    return drained(stream, "events").select("event_id", "user_id", "event_type")


@plans.query("select distinct event_id, user_id, event_type from events")
def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events delivered in several files, one a batch: those on time each once, and the late ones from their own table."""
    path = _place(spark, "deliveries")
    table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type").repartition(4, "event_id").write.parquet(f"{path}/events.parquet")
    rows, late = with_late_rows(stream_table(spark, path, "events", files_per_batch=1), ["event_id"], "ts", "10 days")
    return rows.unionByName(late).select("event_id", "user_id", "event_type").distinct()


@plans.query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    counts = drained(windowed_counts(stream_table(spark, folder, "events").select("ts", "event_type"), "ts", "event_type"), "rates", complete=True)
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES, ORACLE = plans.queries, plans.oracle
