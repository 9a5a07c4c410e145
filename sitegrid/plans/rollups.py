"""Rollups of the same measures over levels, wide tables with explicit null meaning, and drift between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrid.functions.bands import bit_flags, ordinal, recode
from sitegrid.operators import drift, stars
from sitegrid.operators.dedup import first_by, join_unique, latest_by
from sitegrid.operators.measures import Measure, class_shares, either_sum, exact_sum, rollup_levels, share, share_of_all, summarise, three_state
from sitegrid.operators.ranks import with_quantiles
from sitegrid.plans.profiles import LINES_SQL, MONEY, VILLAGES_SQL, lines, villages
from sitegrid.plans.registry import Plans
from sitegrid.sources.tables import table

plans = Plans()

_ORDER_MEASURES_SQL = """count(*) as n_lines, count(distinct o_orderkey) as n_orders, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, round(100.0 * count(*) filter (where l_discount = 0) / nullif(count(l_discount), 0), 2) as pct_undiscounted,
round(median(l_extendedprice), 4) as median_price, round(median(l_extendedprice) filter (where l_returnflag = 'R'), 4) as median_returned_price"""


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    li = lines(spark, folder).select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag")
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, folder, "region").select("r_regionkey", "r_name")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return joined.join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)


def _order_rollup(spark: SparkSession, folder: str, by: str) -> DataFrame:
    rows, price = _order_lines(spark, folder), F.col("l_extendedprice")
    groups = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("o_orderkey").alias("n_orders"), exact_sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("quantity"), share(F.col("l_discount") == 0).alias("pct_undiscounted"),
    )
    return with_quantiles(groups, rows, [by], {"median_price": (price, 0.5), "median_returned_price": (F.when(F.col("l_returnflag") == "R", price), 0.5)})


_ORDER_JOIN_SQL = "from li join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@plans.query(f"with {LINES_SQL} select r_name, {_ORDER_MEASURES_SQL} {_ORDER_JOIN_SQL} group by 1")
def region_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _order_rollup(spark, folder, "r_name")


@plans.query(f"with {LINES_SQL} select n_name, {_ORDER_MEASURES_SQL} {_ORDER_JOIN_SQL} group by 1")
def nation_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _order_rollup(spark, folder, "n_name")


@plans.query(f"with {LINES_SQL} select c_mktsegment, {_ORDER_MEASURES_SQL} {_ORDER_JOIN_SQL} group by 1")
def segment_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _order_rollup(spark, folder, "c_mktsegment")


_LEVELS = {"national": [], "province": ["province_id"], "district": ["district_id"], "subdistrict": ["district_id", "subdistrict_id"]}
_COMPLIANCE_SQL = "count(*) as villages, cast(sum(npwp_count) as bigint) as npwp, cast(sum(nib_count) as bigint) as nib, round(100.0 * count(*) filter (where npwp_count > 0) / nullif(count(npwp_count), 0), 2) as pct_npwp, round(100.0 * count(*) filter (where transaction_value > 0) / nullif(count(*), 0), 2) as pct_trading, cast(sum(transaction_value) as bigint) as transaction_value"


@plans.query(f"""with {VILLAGES_SQL} select 'national' as level, 'all' as key, {_COMPLIANCE_SQL} from v
union all select 'province', cast(province_id as varchar), {_COMPLIANCE_SQL} from v group by province_id
union all select 'district', cast(district_id as varchar), {_COMPLIANCE_SQL} from v group by district_id
union all select 'subdistrict', district_id || ' / ' || subdistrict_id, {_COMPLIANCE_SQL} from v group by district_id, subdistrict_id""")
def multi_level_compliance(spark: SparkSession, folder: str) -> DataFrame:
    v = villages(spark, folder, "province_id", "district_id", "subdistrict_id", "npwp_count", "nib_count", "transaction_value")
    trading = F.col("transaction_value") > 0
    measures = [F.count(F.lit(1)).alias("villages"), exact_sum("npwp_count").cast("bigint").alias("npwp"), exact_sum("nib_count").cast("bigint").alias("nib"), share(F.col("npwp_count") > 0).alias("pct_npwp"), share_of_all(trading).alias("pct_trading"), exact_sum("transaction_value").cast("bigint").alias("transaction_value")]
    return rollup_levels(v, _LEVELS, measures)


@plans.query(f"""with {VILLAGES_SQL}, t as (select 'province' as level, sum(n) as n, sum(s) as s from (select count(*) n, sum(transaction_value) s from v group by province_id)
union all select 'district', sum(n), sum(s) from (select count(*) n, sum(transaction_value) s from v group by district_id)), w as (select count(*) n, sum(transaction_value) s from v)
select level, cast(t.n as bigint) as villages, t.n = w.n and t.s is not distinct from w.s as reconciles from t, w""")
def level_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    v = villages(spark, folder, "province_id", "district_id", "subdistrict_id", "transaction_value")
    levels = rollup_levels(v, {k: _LEVELS[k] for k in ("national", "province", "district")}, [F.count(F.lit(1)).alias("villages"), exact_sum("transaction_value").alias("s")])
    totals = levels.groupBy("level").agg(F.sum("villages").alias("villages"), F.sum("s").alias("s"))
    whole = totals.where("level = 'national'").select(F.col("villages").alias("n"), F.col("s").alias("t"))
    return totals.where("level <> 'national'").join(F.broadcast(whole)).select("level", "villages", ((F.col("villages") == F.col("n")) & F.col("s").eqNullSafe(F.col("t"))).alias("reconciles"))


PRIORITY = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": None, "5-LOW": "low"}


@plans.query(f"""with o as (select c_mktsegment, case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' end c from orders join customer on o_custkey = c_custkey)
select c_mktsegment, {', '.join(f"round(100.0 * count(*) filter (where c = '{k}') / nullif(count(c), 0), 2) as priority_share_{k}" for k in ("high", "medium", "low"))} from o group by 1""")
def class_shares_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = {k: v for k, v in PRIORITY.items() if v}
    return joined.withColumn("priority_class", recode(F.col("o_orderpriority"), known)).groupBy("c_mktsegment").agg(*class_shares("priority", ["high", "medium", "low"]))


_COOPS_SQL = "c as (select cooperative_id, arg_max(struct_pack(p := upper(trim(regexp_replace(province, '\\s+', ' ', 'g'))), lat := latitude, m := dist_cemetery_m, s := asset_status, v := dist_village_m, f := in_farmland), screened_at) r from cemetery_candidates group by 1)"


def _coops(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Cooperatives, each by its latest screening."""
    rows = table(spark, folder, "cemetery_candidates").where(F.col("cooperative_id").isNotNull()).select("cooperative_id", "screened_at", *columns)
    return latest_by(rows, ["cooperative_id"], "screened_at")


@plans.query(f"""with {_COOPS_SQL} select r.p as province, count(*) as cooperatives, round(100.0 * count(*) filter (where r.m <= 3000) / nullif(count(r.m), 0), 2) as pct_of_known, round(100.0 * count(*) filter (where r.m is null or r.m > 3000) / nullif(count(*), 0), 2) as pct_far_of_all from c group by 1""")
def null_denominator_pair(spark: SparkSession, folder: str) -> DataFrame:
    """A share whose denominator is the known rows beside one whose null is itself the finding."""
    d = F.col("dist_cemetery_m")
    return _coops(spark, folder, "province", "dist_cemetery_m").groupBy(stars.folded("province").alias("province")).agg(F.count(F.lit(1)).alias("cooperatives"), share(d <= 3000, d.isNotNull()).alias("pct_of_known"), share_of_all(d.isNull() | (d > 3000)).alias("pct_far_of_all"))


@plans.query(f"""with {VILLAGES_SQL}, d as (select doc_id, district_id from documents), t as (select district_id, sum(transaction_value) s from v group by 1), j as (select d.district_id is not null and t.district_id is not null linked, s > 0 pos from d left join t using (district_id))
select case when not linked then null else coalesce(pos, false) end as reported, count(*) as n from j group by 1""")
def three_state_flag(spark: SparkSession, folder: str) -> DataFrame:
    per = villages(spark, folder, "district_id", "transaction_value").groupBy("district_id").agg(exact_sum("transaction_value").alias("s"), F.lit(True).alias("linked"))
    joined = table(spark, folder, "documents").select("doc_id", "district_id").join(per, "district_id", "left")
    return joined.groupBy(three_state(F.coalesce("linked", F.lit(False)), F.col("s") > 0).alias("reported")).agg(F.count(F.lit(1)).alias("n"))


@plans.query("""with o as (select o_custkey, count(*) n_orders, max(o_orderdate) last_order from orders group by 1), e as (select user_id, count(*) n_events from events group by 1)
select c_custkey, c_name, n_name, r_name, coalesce(n_orders, 0) as n_orders, strftime(last_order, '%Y-%m-%d') as last_order, n_events, n_events is not null as has_events, case when c_acctbal < 0 then 'overdrawn' when c_acctbal < 5000 then 'small' else 'large' end as balance_class,
'https://maps.example.org/@' || c_custkey || ',' || c_nationkey as link from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join o on c_custkey = o_custkey left join e on c_custkey = user_id""")
def mart_points(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    n = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    wide = stars.star_join(table(spark, folder, "customer"), [(n, ["c_nationkey"]), (r, ["n_regionkey"]), (o, ["c_custkey"]), (e, ["c_custkey"])])
    balance = F.when(F.col("c_acctbal") < 0, "overdrawn").when(F.col("c_acctbal") < 5000, "small").otherwise("large")
    return wide.select(
        "c_custkey", "c_name", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.date_format("last_order", "yyyy-MM-dd").alias("last_order"), "n_events", F.col("n_events").isNotNull().alias("has_events"), balance.alias("balance_class"),
        F.concat(F.lit("https://maps.example.org/@"), F.col("c_custkey").cast("string"), F.lit(","), F.col("c_nationkey").cast("string")).alias("link"),
    )


@plans.query("""with s as (select s_nationkey k, count(*) n_suppliers, round(median(s_acctbal), 4) supplier_median from supplier where s_acctbal > 5000 group by 1), c as (select c_nationkey k, count(*) n_customers from customer where c_mktsegment = 'BUILDING' group by 1)
select coalesce(s.k, c.k) as nationkey, n_suppliers, supplier_median, n_customers from s full join c on s.k = c.k""")
def rollup_outer(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "supplier").where("s_acctbal > 5000").withColumn("nationkey", F.col("s_nationkey"))
    s = with_quantiles(rich.groupBy("nationkey").agg(F.count(F.lit(1)).alias("n_suppliers")), rich, ["nationkey"], {"supplier_median": (F.col("s_acctbal"), 0.5)})
    c = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    return stars.outer_rollup(s, c, ["nationkey"])


@plans.query("""with k as (select cooperative_id, arg_max(latitude, screened_at) lat, arg_max(longitude, screened_at) lon from (select cooperative_id, screened_at, struct_pack(a := latitude, b := longitude) p, latitude, longitude from cemetery_candidates where latitude is not null and longitude is not null) group by 1),
b as (select cooperative_id, arg_max(struct_pack(a := latitude, b := longitude), screened_at) r from cemetery_candidates group by 1),
o as (select cooperative_id, arg_max(struct_pack(a := lat_2026_08_17, b := lon_2026_08_17), received_at) r from corrected_coordinates_2026_08 group by 1)
select b.cooperative_id, coalesce(o.r.a, b.r.a) as latitude, coalesce(o.r.b, b.r.b) as longitude, case when o.cooperative_id is not null then 'override' else 'base' end as source from b left join o using (cooperative_id)""")
def override_latest(spark: SparkSession, folder: str) -> DataFrame:
    base = _coops(spark, folder, "latitude", "longitude").drop("screened_at")
    return stars.override_latest(base, table(spark, folder, "corrected_coordinates_2026_08"), "cooperative_id", "received_at", {"latitude": "lat_2026_08_17", "longitude": "lon_2026_08_17"})


_FOLD = "upper(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@plans.query(f"""with {VILLAGES_SQL}, vs as (select {_FOLD.format('province')} p, {_FOLD.format('district')} d, {_FOLD.format('subdistrict')} s, {_FOLD.format('village')} vi, village_id, transaction_value from v
  where province is not null and district is not null and subdistrict is not null and village is not null qualify row_number() over (partition by p, d, s, vi order by village_id) = 1),
la as (select * from land_assets qualify row_number() over (partition by asset_id order by surveyed_at desc) = 1)
select asset_id, vs.village_id, transaction_value, vs.village_id is not null as linked from la left join vs on {_FOLD.format('la.province')} = p and {_FOLD.format('la.district')} = d and {_FOLD.format('la.subdistrict')} = s and {_FOLD.format('la.village')} = vi""")
def village_link(spark: SparkSession, folder: str) -> DataFrame:
    names = ["province", "district", "subdistrict", "village"]
    v = villages(spark, folder, *names, "transaction_value")
    assets = latest_by(table(spark, folder, "land_assets"), ["asset_id"], "surveyed_at", ["asset_id", "surveyed_at", *names])
    return stars.name_path_join(assets, v, names, ["village_id", "transaction_value"], ["village_id"]).select("asset_id", "village_id", "transaction_value", F.col("village_id").isNotNull().alias("linked"))


@plans.query("""select l_orderkey, l_linenumber, o_custkey from lineitem left join orders on l_orderkey = o_orderkey""")
def guarded_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with its order's customer: as many rows as lines."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return join_unique(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


_SCORE_SQL = f"{_COOPS_SQL}, s as (select cooperative_id, (case when r.v > 2000 then 2 else 0 end + case when coalesce(r.m, 0) < 1000 then 2 else 0 end + case when coalesce(r.f, false) then 1 else 0 end) as score, r.v as v from c)"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    far, near, farm = F.col("dist_village_m") > 2000, F.coalesce("dist_cemetery_m", F.lit(0.0)) < 1000, F.coalesce("in_farmland", F.lit(False))
    score = F.when(far, 2).otherwise(0) + F.when(near, 2).otherwise(0) + F.when(farm, 1).otherwise(0)
    return _coops(spark, folder, "dist_village_m", "dist_cemetery_m", "in_farmland").withColumns({"score": score, "far": far, "near": near, "farm": farm})


@plans.query(f"with {_SCORE_SQL} select score, count(*) as n from s group by 1")
def isolation_score(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@plans.query(f"with {_SCORE_SQL} select cooperative_id, score, v as dist_village_m from s order by score desc, v desc nulls last, cooperative_id limit 25")
def shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 highest scores: a distributed top-k."""
    return _scored(spark, folder).orderBy(F.desc("score"), F.desc_nulls_last("dist_village_m"), "cooperative_id").limit(25).select("cooperative_id", "score", "dist_village_m")


@plans.query(f"with {_COOPS_SQL} select (case when r.v > 2000 then 1 else 0 end + case when r.m < 1000 then 2 else 0 end + case when r.f then 4 else 0 end) as flags, count(*) as n from c group by 1")
def island_flags_bitmask(spark: SparkSession, folder: str) -> DataFrame:
    rows = _coops(spark, folder, "dist_village_m", "dist_cemetery_m", "in_farmland")
    return rows.groupBy(bit_flags([F.col("dist_village_m") > 2000, F.col("dist_cemetery_m") < 1000, F.col("in_farmland")]).alias("flags")).agg(F.count(F.lit(1)).alias("n"))


_STATUS = ["draft", "returned", "in review", "verified"]


@plans.query(f"with {_COOPS_SQL} select nullif(coalesce(list_position(['draft', 'returned', 'in review', 'verified'], lower(trim(r.s))), 0), 0) as status_code, count(*) as n from c group by 1")
def ordinal_codes(spark: SparkSession, folder: str) -> DataFrame:
    return _coops(spark, folder, "asset_status").groupBy(ordinal(F.lower(F.trim("asset_status")), _STATUS).alias("status_code")).agg(F.count(F.lit(1)).alias("n"))


@plans.query(f"""with {_COOPS_SQL}, g as (select r.p as province, count(*) as members, count(*) filter (where r.m < 1000) as near_cemetery_hits, count(r.m) as near_cemetery_known, count(*) filter (where r.v > 2000) as far_village_hits, count(r.v) as far_village_known from c group by 1)
select *, round(100.0 * near_cemetery_hits / nullif(near_cemetery_known, 0), 2) as near_cemetery_pct, round(100.0 * far_village_hits / nullif(far_village_known, 0), 2) as far_village_pct from g""")
def measure_registry_summary(spark: SparkSession, folder: str) -> DataFrame:
    m, v = F.col("dist_cemetery_m"), F.col("dist_village_m")
    rows = _coops(spark, folder, "province", "dist_cemetery_m", "dist_village_m").withColumn("province", stars.folded("province"))
    return summarise(rows, ["province"], [Measure("near_cemetery", m.isNotNull(), m < 1000), Measure("far_village", v.isNotNull(), v > 2000)])


@plans.query(f"""with {_COOPS_SQL}, g as (select r.p p, round(100.0 * count(*) filter (where r.m < 500) / nullif(count(r.m), 0), 2) a, round(100.0 * count(*) filter (where r.m >= 500 and r.m < 1500) / nullif(count(r.m), 0), 2) b from c group by 1)
select p as province, round(case when a is null and b is null then null else coalesce(a, 0) + coalesce(b, 0) end, 2) as within_1500 from g""")
def null_aware_sum(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("dist_cemetery_m")
    g = _coops(spark, folder, "province", "dist_cemetery_m").groupBy(stars.folded("province").alias("province")).agg(share(m < 500).alias("a"), share((m >= 500) & (m < 1500)).alias("b"))
    return g.select("province", F.round(either_sum(F.col("a"), F.col("b")), 2).alias("within_1500"))


_DAY_SQL = "(select * from stats_village where snapshot_date = date '{}' and village_id is not null qualify row_number() over (partition by village_id order by loaded_at desc) = 1)"


def _day(spark: SparkSession, folder: str, day: str) -> DataFrame:
    rows = table(spark, folder, "stats_village").where((F.col("snapshot_date") == F.lit(day).cast("date")) & F.col("village_id").isNotNull())
    return latest_by(rows, ["village_id"], "loaded_at", ["village_id", "loaded_at", *MONEY])


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return drift.side_by_side(_day(spark, folder, "2026-08-05"), _day(spark, folder, "2026-08-17"), "village_id", MONEY)


_PAIRS_SQL = f"a as {_DAY_SQL.format('2026-08-05')}, b as {_DAY_SQL.format('2026-08-17')}"


@plans.query(f"""with {_PAIRS_SQL}, long as ({' union all '.join(f"select '{m}' as measure, a.{m}::double as x, b.{m}::double as y from a join b using (village_id)" for m in MONEY)})
select measure, count(*) as n_both, count(*) filter (where x is distinct from y) as n_changed, round(100.0 * count(*) filter (where x is distinct from y) / count(*), 2) as pct_changed, count(*) filter (where x = 0 and y > 0) as n_from_zero, count(*) filter (where x > 0 and y = 0) as n_to_zero, sum(coalesce(y, 0) - coalesce(x, 0)) as net from long group by 1""")
def snapshot_diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drift_summary(_pairs(spark, folder), MONEY)


@plans.query(f"with {_PAIRS_SQL} select case when b.village_id is null then 'only before' when a.village_id is null then 'only after' else 'both' end as side, count(*) as n from a full join b using (village_id) group by 1")
def snapshot_sides(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


_SERIES_SQL = "s as (select snapshot_date as day, sum(transaction_value)::double as value from (select * from stats_village where village_id is not null qualify row_number() over (partition by village_id, snapshot_date order by loaded_at desc) = 1) group by 1)"


@plans.query(f"""with {_SERIES_SQL} select day, value, value - lag(value) over (order by day) as change, round(100.0 * (value - lag(value) over (order by day)) / nullif(lag(value) over (order by day), 0), 4) as pct_growth, cast(date_diff('day', lag(day) over (order by day), day) as integer) as days from s""")
def published_series(spark: SparkSession, folder: str) -> DataFrame:
    latest = latest_by(table(spark, folder, "stats_village").where("village_id is not null"), ["village_id", "snapshot_date"], "loaded_at", ["village_id", "snapshot_date", "loaded_at", "transaction_value"])
    totals = latest.groupBy(F.col("snapshot_date").alias("day")).agg(exact_sum("transaction_value").cast("double").alias("value"))
    return drift.series_growth(totals, "day", "value")


@plans.query("""with s as (select cast(date_trunc('month', o_orderdate) as date) as day, sum(cast(round(o_totalprice * 100) as bigint))::double / 100 as value from orders group by 1), h as (select max(day) d1, min(day) d0 from s)
select date_diff('day', d0, d1) as days, round((select value from s, h where day = d0), 2) as first_value, round((select value from s, h where day = d1), 2) as last_value, round(100.0 * ((select value from s, h where day = d1) / (select value from s, h where day = d0) - 1) * 365 / date_diff('day', d0, d1), 4) as annual_pct from h""")
def drift_horizon(spark: SparkSession, folder: str) -> DataFrame:
    months = table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "month").alias("day")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100).alias("value"))
    ends = months.agg(F.min(F.struct("day", "value")).alias("a"), F.max(F.struct("day", "value")).alias("b"))
    days = F.datediff("b.day", "a.day").cast("bigint")
    return ends.select(days.alias("days"), F.round("a.value", 2).alias("first_value"), F.round("b.value", 2).alias("last_value"), F.round(100.0 * (F.col("b.value") / F.col("a.value") - 1) * 365 / days, 4).alias("annual_pct"))


@plans.query("""with a as (select snapshot_date d, sum(transaction_value)::bigint x from stats_province group by 1), b as (select snapshot_date d, count(*) n, round(avg(health_score), 4) y from (select distinct * from health_index_by_province) where province_id is not null group by 1)
select strftime(d, '%Y-%m-%d') as day, x as transaction_value, n as scored, y as mean_score from a join b using (d)""")
def same_day_series(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "stats_province").groupBy("snapshot_date").agg(exact_sum("transaction_value").cast("bigint").alias("transaction_value"))
    b = table(spark, folder, "health_index_by_province").distinct().where("province_id is not null").groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("scored"), F.round(F.avg("health_score"), 4).alias("mean_score"))
    return a.join(b, "snapshot_date").select(F.col("snapshot_date").cast("string").alias("day"), "transaction_value", "scored", "mean_score")


@plans.query(f"""with {VILLAGES_SQL}, d as (select distinct province_id, district_id, {_FOLD.format('district')} name from v where district is not null), la as (select distinct {_FOLD.format('province')} p, {_FOLD.format('district')} l from land_assets where province is not null and district is not null),
r as (select {_FOLD.format('province')} p, {_FOLD.format('district')} r, min(district_id) k from v where province is not null and district is not null group by 1, 2),
s as (select la.p, l, r, k, round(1 - levenshtein(l, r)::double / greatest(length(l), length(r)), 4) sim from la join r using (p)),
best as (select * from s where sim >= 0.82 qualify row_number() over (partition by p, l order by sim desc, r) = 1)
select p as province, l as district, k as matched_district_id, case when sim = 1 then 'exact' when sim is not null then 'similar' end as match, sim as similarity from la left join best using (p, l)""")
def name_cascade(spark: SparkSession, folder: str) -> DataFrame:
    assets = table(spark, folder, "land_assets").select(stars.folded("province").alias("province"), stars.folded("district").alias("district")).dropna().distinct()
    v = villages(spark, folder, "province", "district", "district_id").withColumn("province", stars.folded("province"))
    return stars.cascade_match(assets, v, "province", "district", "district", "district_id")


@plans.query("""select cooperative_id, first_day as first_fixed, n_known from (
select cooperative_id, least(case when d1 then '2026-08-09' end, case when d2 then '2026-08-13' end, case when d3 then '2026-08-17' end) first_day, n_known from (
select cooperative_id, bool_or(abs(lat_2026_08_09 - lat_2026_08_05) > 0.00001) d1, bool_or(abs(lat_2026_08_13 - lat_2026_08_05) > 0.00001) d2, bool_or(abs(lat_2026_08_17 - lat_2026_08_05) > 0.00001) d3, count(lat_2026_08_05) n_known from corrected_coordinates_2026_08 group by 1))""")
def first_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """The first snapshot at which a coordinate differs from the first one's."""
    df = table(spark, folder, "corrected_coordinates_2026_08")
    days = ["2026-08-09", "2026-08-13", "2026-08-17"]
    moved = lambda d: F.bool_or(F.abs(F.col(f"lat_{d.replace('-', '_')}") - F.col("lat_2026_08_05")) > 0.00001)
    g = df.groupBy("cooperative_id").agg(*[moved(d).alias(d) for d in days], F.count("lat_2026_08_05").alias("n_known"))
    return g.select("cooperative_id", F.least(*[F.when(F.col(f"`{d}`"), F.lit(d)) for d in days]).alias("first_fixed"), "n_known")


@plans.query("""with w as (select *, sum(l_quantity) over (partition by l_orderkey) total from (select distinct l_orderkey, l_linenumber, l_quantity from lineitem)) select l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) over (partition by l_orderkey), 4) as demeaned, round(100.0 * l_quantity / nullif(total, 0), 2) as pct from w""")
def group_mean_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    w = Window.partitionBy("l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") - F.avg("l_quantity").over(w), 4).alias("demeaned"), F.round(100.0 * F.col("l_quantity") / F.nullif(F.sum("l_quantity").over(w), F.lit(0.0)), 2).alias("pct"))


@plans.query("""with f as (select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1) select * from f""")
def first_order(spark: SparkSession, folder: str) -> DataFrame:
    return first_by(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@plans.query("select c_custkey, (c_custkey * 7919 + 104729) % 1000003 as h from customer order by h, c_custkey limit 40")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A repeatable sample of 40 rows: the least values of a hash, whatever the partitions."""
    return table(spark, folder, "customer").select("c_custkey", F.pmod(F.col("c_custkey") * 7919 + 104729, F.lit(1000003)).alias("h")).orderBy("h", "c_custkey").limit(40)


QUERIES, ORACLE = plans.queries, plans.oracle
