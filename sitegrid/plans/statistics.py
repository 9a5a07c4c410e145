"""Rank correlations and null models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.operators import rings, stats
from sitegrid.operators.measures import exact_sum
from sitegrid.plans.profiles import VILLAGES_SQL, villages
from sitegrid.operators.ranks import with_quantiles
from sitegrid.plans.registry import Plans
from sitegrid.plans.spatial import ASSETS_SQL, MARKETS_SQL, POINTS_SQL, assets, coops, in_cells, markets
from sitegrid.sources.tables import table

plans = Plans()
REDRAWS, DRAWS, NEAR = 40, 500, 8

_CUSTOMERS_SQL = "cu as (select c_custkey, c_nationkey, c_acctbal x, coalesce(n, 0) y from customer left join (select o_custkey, count(*) n from orders group by 1) on c_custkey = o_custkey)"
_RANK = "rank() over ({p}order by {c}) + (count(*) over (partition by {q}{c}) - 1) / 2.0"


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "customer").join(o, "c_custkey", "left").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("x"), F.coalesce("n", F.lit(0)).alias("y"))


@plans.query(f"with {_CUSTOMERS_SQL}, r as (select {_RANK.format(p='', q='', c='x')} rx, {_RANK.format(p='', q='', c='y')} ry from cu) select round(corr(rx, ry), 6) as rho, count(*) as n from r")
def spearman_pair(spark: SparkSession, folder: str) -> DataFrame:
    return stats.spearman(_customers(spark, folder), "x", "y")


@plans.query(f"with {_CUSTOMERS_SQL}, r as (select c_nationkey, {_RANK.format(p='partition by c_nationkey ', q='c_nationkey, ', c='x')} rx, {_RANK.format(p='partition by c_nationkey ', q='c_nationkey, ', c='y')} ry from cu) select c_nationkey, round(corr(rx, ry), 6) as rho, count(*) as n from r group by 1")
def spearman_within_group(spark: SparkSession, folder: str) -> DataFrame:
    return stats.spearman(_customers(spark, folder), "x", "y", ["c_nationkey"])


@plans.query(f"with {VILLAGES_SQL}, d as (select transaction_value x, savings_total_amount y from v where transaction_value is not null and savings_total_amount is not null), r as (select {_RANK.format(p='', q='', c='x')} rx, {_RANK.format(p='', q='', c='y')} ry from d) select round(corr(rx, ry), 6) as rho, count(*) as n from r")
def spearman_zero_inflated(spark: SparkSession, folder: str) -> DataFrame:
    return stats.spearman(villages(spark, folder, "transaction_value", "savings_total_amount"), "transaction_value", "savings_total_amount")


_DRIVERS = ("scored_share", "healthy_count", "unhealthy_count", "average_health_index")
# the two-sided p of Student's t with a whole number of degrees of freedom is a finite sum in the cosine of its angle
_DRIVERS_SQL = f"""with h as (select distinct * from health_index_by_province), long as ({' union all '.join(f"select '{d}' driver, {d}::double x, health_score::double y from h where {d} is not null and health_score is not null" for d in _DRIVERS)}),
ranked as (select driver, rank() over (partition by driver order by x) + (count(*) over (partition by driver, x) - 1) / 2.0 rx, rank() over (partition by driver order by y) + (count(*) over (partition by driver, y) - 1) / 2.0 ry from long),
r as (select driver, round(corr(rx, ry), 6) rho, count(*) n from ranked group by 1), f as (select *, n - 2 as df, 1 - rho * rho as c2 from r),
j as (select driver, unnest(range(1, (df - 2 - df % 2) // 2 + 1)) j, df, c2 from f), t as (select driver, exp(sum(ln(c2 * case when df % 2 = 1 then 2 * j / (2 * j + 1.0) else (2 * j - 1) / (2.0 * j) end)) over (partition by driver order by j)) t from j),
s as (select driver, sum(t) s from t group by 1)
select driver, rho, n, round(case when abs(rho) >= 1 then 0 when df % 2 = 1 then 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * sqrt(c2) * (1 + coalesce(s, 0))) else 1 - abs(rho) * (1 + coalesce(s, 0)) end, 6) + 0.0 as p from f left join s using (driver)"""


@plans.query(_DRIVERS_SQL)
def spearman_drivers(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of each driver with the province's score, with its two-sided p."""
    h = table(spark, folder, "health_index_by_province").distinct()
    out = None
    for driver in _DRIVERS:
        one = stats.spearman(h, driver, "health_score").select(F.lit(driver).alias("driver"), "rho", "n", F.round(stats.spearman_p("rho", "n"), 6).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


@plans.query("with r as (select s_suppkey, rank() over (order by floor(s_acctbal / 1000)) + (count(*) over (partition by floor(s_acctbal / 1000)) - 1) / 2.0 as k from supplier) select s_suppkey, cast(k as double) as rank from r")
def average_rank(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal") / 1000).alias("v"))
    return s.join(stats.average_ranks(s, "v").select("v", "rank"), "v").select("s_suppkey", "rank")


def _u(i: str, d: str) -> str:
    return f"((({i} * {stats.MIX} + {d} * 7919 + 12345) % {stats.MODULUS}) * {stats.MULTIPLIER} % {stats.MODULUS}) * {stats.MULTIPLIER} % {stats.MODULUS}"


_POOL_SQL = f"{ASSETS_SQL}, {MARKETS_SQL}, w as (select x, y, x * 100000 + y as o, count(*) w from la group by 1, 2), nr as (select w.x, w.y, min(greatest(abs(mk.x - w.x), abs(mk.y - w.y))) k from w, mk group by 1, 2)"
_PLACED_SQL = "pl as (select *, sum(w) over (order by o) - w lo, sum(w) over (order by o) hi, sum(w) over () total from w)"


def _pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cells weighted by assets, and each one's ring to a market (null beyond the cap of 8)."""
    cells = in_cells(assets(spark, folder)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).withColumn("o", F.col("x") * 100_000 + F.col("y"))
    near = rings.nearest_ring(cells, in_cells(markets(spark, folder)), NEAR)
    return cells, near


@plans.query(f"with {_POOL_SQL}, {_PLACED_SQL}, d as (select i, {_u('i', '0')} u from range(0, {DRAWS}) t(i)) select x, y, count(*) as n from d join pl on u % total >= lo and u % total < hi group by 1, 2")
def weighted_null(spark: SparkSession, folder: str) -> DataFrame:
    cells, _ = _pool(spark, folder)
    draws = spark.range(DRAWS).select(F.lit(0).alias("draw"), F.col("id").alias("i"))
    return stats.weighted_draws(cells, "o", "w", draws).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


_REDRAW_SQL = f"{_POOL_SQL}, {_PLACED_SQL}, d as (select draw, i, {_u('i', 'draw')} u from range(0, {DRAWS}) t(i), range(0, {REDRAWS}) s(draw)), g as (select draw, 100.0 * count(*) filter (where k <= {NEAR}) / count(*) pct from d join pl on u % total >= lo and u % total < hi join nr using (x, y) group by 1)"


def _redraws(spark: SparkSession, folder: str) -> DataFrame:
    """Percent of drawn cells near a market, per redraw; all redraws in one job."""
    cells, near = _pool(spark, folder)
    draws = spark.range(DRAWS * REDRAWS).select(F.floor(F.col("id") / DRAWS).alias("draw"), F.pmod("id", F.lit(DRAWS)).alias("i"))
    drawn = stats.weighted_draws(cells, "o", "w", draws)
    return drawn.join(near, ["x", "y"]).groupBy("draw").agg((100.0 * F.count("k") / F.count(F.lit(1))).alias("pct"))


@plans.query(f"with {_REDRAW_SQL} select round(avg(pct), 4) as mean, round(quantile_cont(pct, 0.025), 4) as lo95, round(quantile_cont(pct, 0.975), 4) as hi95, count(*) as n from g")
def null_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return stats.envelope(_redraws(spark, folder), [], "pct")


@plans.query(f"with {POINTS_SQL}, {_REDRAW_SQL}, ac as (select id, min(greatest(abs(mk.x - pt.x), abs(mk.y - pt.y))) k from pt, mk group by 1) select round((select 100.0 * count(*) filter (where k <= {NEAR}) / count(*) from ac), 4) as actual, round((select avg(pct) from g), 4) as expected, round((select 100.0 * count(*) filter (where k <= {NEAR}) / count(*) from ac) - (select avg(pct) from g), 4) as excess_pp")
def null_comparison(spark: SparkSession, folder: str) -> DataFrame:
    points = in_cells(coops(spark, folder))
    near = rings.with_ring(points, rings.nearest_ring(points, in_cells(markets(spark, folder)), NEAR))
    actual = near.agg((100.0 * F.count("k") / F.count(F.lit(1))).alias("actual"))
    expected = _redraws(spark, folder).agg(F.avg("pct").alias("expected"))
    return actual.join(F.broadcast(expected)).select(F.round("actual", 4).alias("actual"), F.round("expected", 4).alias("expected"), F.round(F.col("actual") - F.col("expected"), 4).alias("excess_pp"))


_MATCH_SQL = f"""{POINTS_SQL}, {ASSETS_SQL}, t as (select pt.id as i, count(la.asset_id) as v from pt left join la on abs(la.x - pt.x) <= 2 and abs(la.y - pt.y) <= 2 group by 1), c as (select distinct x, y, x * 100000 + y o from la), p as (select c.o, count(la.asset_id) as v from c join la on abs(la.x - c.x) <= 2 and abs(la.y - c.y) <= 2 group by 1),
e as (select distinct unnest(quantile_cont(v::double, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) q from t), tb as (select i, (select count(*) from e where t.v > q) bin from t), pb as (select o, bin, row_number() over (partition by bin order by o) - 1 slot, count(*) over (partition by bin) size from (select o, (select count(*) from e where p.v > q) bin from p))"""


@plans.query(f"with {_MATCH_SQL} select tb.i, cast(tb.bin as integer) as bin, o from tb join pb on tb.bin = pb.bin and ({_u('tb.i', '0')}) % size = slot")
def matched_null(spark: SparkSession, folder: str) -> DataFrame:
    """For each cooperative a cell with as many assets around it (same decile)."""
    weights = in_cells(assets(spark, folder))
    points = in_cells(coops(spark, folder))
    targets = points.join(rings.catchments(points, weights, 2, "v"), ["x", "y"]).select(F.col("point_id").alias("i"), "v")
    pool = rings.catchments(weights, weights, 2, "v").select((F.col("x") * 100_000 + F.col("y")).alias("o"), "v")
    return stats.matched_draws(targets, pool, "v", "o")


@plans.query(f"with {_MATCH_SQL}, m as (select tb.bin, pb.o, t.v from tb join pb on tb.bin = pb.bin and ({_u('tb.i', '0')}) % size = slot join t using (i)) select 'actual' as side, round(median(v), 4) as median_v, count(*) as n from m union all select 'matched', round(median(p.v), 4), count(*) from m join p using (o)")
def match_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Medians of the matched variable on both sides: near each other if the match is good."""
    weights = in_cells(assets(spark, folder))
    points = in_cells(coops(spark, folder))
    targets = points.join(rings.catchments(points, weights, 2, "v"), ["x", "y"]).select(F.col("point_id").alias("i"), "v")
    pool = rings.catchments(weights, weights, 2, "v").select((F.col("x") * 100_000 + F.col("y")).alias("o"), "v")
    drawn = stats.matched_draws(targets, pool, "v", "o")
    sides = drawn.join(targets, "i").select(F.lit("actual").alias("side"), "v").unionByName(drawn.join(pool, "o").select(F.lit("matched").alias("side"), "v"))
    return with_quantiles(sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")), sides, ["side"], {"median_v": (F.col("v"), 0.5)})


@plans.query(f"with {VILLAGES_SQL}, a as (select province_id, sum(cooperatives)::bigint c from v group by 1) select s.province_id, a.c as listed, s.cooperatives as published, round(100.0 * a.c / nullif(s.cooperatives, 0), 2) as coverage_pct from stats_province s left join a using (province_id) where snapshot_date = date '2026-08-17'")
def published_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the village file holds of the number published per province."""
    a = villages(spark, folder, "province_id", "cooperatives").groupBy("province_id").agg(exact_sum("cooperatives").cast("bigint").alias("listed"))
    s = table(spark, folder, "stats_province").where("snapshot_date = date'2026-08-17'").select("province_id", F.col("cooperatives").alias("published"))
    return s.join(a, "province_id", "left").select("province_id", "listed", "published", F.round(100.0 * F.col("listed") / F.nullif(F.col("published"), F.lit(0)), 2).alias("coverage_pct"))


QUERIES, ORACLE = plans.queries, plans.oracle
