"""Profiles of the registry's statistics and of orders: repeats, zeros, concentration, cross-tabs, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions.bands import band_histogram, first_rule, recode, right_closed
from sitegrid.operators import profile
from sitegrid.operators.dedup import duplicate_audit, first_by, latest_by
from sitegrid.operators.ranks import with_quantiles
from sitegrid.plans.registry import Plans
from sitegrid.sources.tables import table

plans = Plans()
LAST = "2026-08-17"
#: Villages of the last snapshot, each by the row loaded last.
VILLAGES_SQL = f"v as (select * from stats_village where snapshot_date = date '{LAST}' and village_id is not null qualify row_number() over (partition by village_id order by loaded_at desc) = 1)"
LINES_SQL = "li as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1)"
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
MONEY = ["transaction_value", "simpanan_pokok_amount", "simpanan_wajib_amount", "savings_total_amount"]


def villages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "stats_village").where((F.col("snapshot_date") == F.lit(LAST).cast("date")) & F.col("village_id").isNotNull())
    return latest_by(rows, ["village_id"], "loaded_at", ["village_id", "loaded_at", *columns]).drop("loaded_at")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return first_by(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@plans.query(f"with {LINES_SQL} select * from li")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder)


@plans.query("""with k as (select count(*) n from lineitem group by l_orderkey, l_linenumber)
select cast(sum(n) as bigint) as n_rows, count(*) as n_keys, cast(sum(n - 1) as bigint) as n_repeated_rows, count(*) filter (where n > 1) as n_repeated_keys, max(n) as most_rows from k""")
def dup_audit(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_audit(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@plans.query("with v as (select snapshot_date, count(*) n, count(distinct village_id) k from stats_village group by all) select strftime(snapshot_date, '%Y-%m-%d') as snapshot, n as n_rows, k as n_villages, n - k as n_repeated from v")
def village_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stats_village").groupBy("snapshot_date", "village_id").agg(F.count(F.lit(1)).alias("n"))
    per_day = rows.groupBy(F.col("snapshot_date").cast("string").alias("snapshot")).agg(F.sum("n").alias("n_rows"), F.count("village_id").alias("n_villages"))
    return per_day.withColumn("n_repeated", F.col("n_rows") - F.col("n_villages"))


@plans.query(f"""with {VILLAGES_SQL}, long as ({' union all '.join(f"select '{c}' as field, {c}::double as value from v" for c in MONEY)})
select field, count(value) as n_known, count(*) - count(value) as n_null, count(*) filter (where value = 0) as n_zero, round(100.0 * count(*) filter (where value = 0) / nullif(count(value), 0), 2) as pct_zero, count(*) filter (where value > 0) as n_positive from long group by field""")
def zero_inflation_by_field(spark: SparkSession, folder: str) -> DataFrame:
    return profile.zero_inflation(villages(spark, folder, *MONEY), MONEY)


@plans.query(f"""with {VILLAGES_SQL} select count(*) filter (where savings_total_amount > 0) as n_savers, count(*) filter (where savings_total_amount > 0 and transaction_value > 0) as n_both,
round(100.0 * count(*) filter (where savings_total_amount > 0 and transaction_value > 0) / nullif(count(*) filter (where savings_total_amount > 0), 0), 2) as pct_given_saving,
round(100.0 * count(*) filter (where transaction_value > 0) / nullif(count(transaction_value), 0), 2) as pct_overall from v""")
def zero_inflation_conditional(spark: SparkSession, folder: str) -> DataFrame:
    saving, trading = F.col("savings_total_amount") > 0, F.col("transaction_value") > 0
    return villages(spark, folder, *MONEY).agg(
        F.count_if(saving).alias("n_savers"), F.count_if(saving & trading).alias("n_both"), F.round(100.0 * F.count_if(saving & trading) / F.nullif(F.count_if(saving), F.lit(0)), 2).alias("pct_given_saving"),
        F.round(100.0 * F.count_if(trading) / F.nullif(F.count("transaction_value"), F.lit(0)), 2).alias("pct_overall"),
    )


@plans.query(f"with {VILLAGES_SQL} select province_id, count(*) as villages, round(100.0 * count(*) filter (where transaction_value = 0) / nullif(count(transaction_value), 0), 2) as pct_zero from v group by 1")
def zero_gradient_by_group(spark: SparkSession, folder: str) -> DataFrame:
    v = villages(spark, folder, "province_id", "transaction_value")
    zero = F.count_if(F.col("transaction_value") == 0)
    return v.groupBy("province_id").agg(F.count(F.lit(1)).alias("villages"), F.round(100.0 * zero / F.nullif(F.count("transaction_value"), F.lit(0)), 2).alias("pct_zero"))


@plans.query(f"""with {VILLAGES_SQL}, r as (select transaction_value, row_number() over (order by transaction_value desc, village_id) rn from v where transaction_value is not null)
select n as top_n, round(100.0 * (select sum(transaction_value) from r where rn <= n) / (select sum(transaction_value) from r), 2) as share from (values (10), (50), (100), (500), (1000)) t(n)""")
def concentration_topn(spark: SparkSession, folder: str) -> DataFrame:
    return profile.concentration(villages(spark, folder, "transaction_value"), "transaction_value", [10, 50, 100, 500, 1000], ["village_id"])


@plans.query("""with u as (select user_id, count(*) filter (where event_type = 'purchase') > 13 as many_purchases, count(*) filter (where event_type = 'error') > 13 as many_errors from events group by 1)
select many_purchases, many_errors, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct from u group by 1, 2""")
def crosstab_2x2(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").groupBy("user_id").agg(*[(F.count_if(F.col("event_type") == k) > 13).alias(k) for k in ("purchase", "error")])
    return profile.crosstab(users, F.col("purchase"), F.col("error"), ("many_purchases", "many_errors"))


BANDS = ["dormant", "saves only", "trades only", "saves and trades", "not linked"]


@plans.query(f"""with {VILLAGES_SQL}, b as (select case when transaction_value is null then 'not linked' when savings_total_amount > 0 and transaction_value > 0 then 'saves and trades' when transaction_value > 0 then 'trades only' when savings_total_amount > 0 then 'saves only' else 'dormant' end band from v),
d(ord, band) as (values {', '.join(f"({i + 1}, '{b}')" for i, b in enumerate(BANDS))})
select ord, d.band, count(b.band) as n, round(100.0 * count(b.band) / sum(count(b.band)) over (), 2) as pct from d left join b on d.band = b.band group by 1, 2""")
def dormancy_bands(spark: SparkSession, folder: str) -> DataFrame:
    trades, saves = F.col("transaction_value") > 0, F.col("savings_total_amount") > 0
    rules = [(F.col("transaction_value").isNull(), "not linked"), (saves & trades, "saves and trades"), (trades, "trades only"), (saves, "saves only")]
    return band_histogram(villages(spark, folder, *MONEY).withColumn("band", first_rule(rules, "dormant")), "band", BANDS)


@plans.query(f"""with {LINES_SQL}, r as (select l_discount / l_tax x from li where l_discount > 0 and l_tax > 0)
select q, round(case q when 0.1 then (select quantile_cont(x, 0.1) from r) when 0.25 then (select quantile_cont(x, 0.25) from r) when 0.5 then (select quantile_cont(x, 0.5) from r) when 0.75 then (select quantile_cont(x, 0.75) from r) else (select quantile_cont(x, 0.9) from r) end, 4) as value,
(select count(*) from r) as n from (values (0.1::double), (0.25::double), (0.5::double), (0.75::double), (0.9::double)) t(q)""")
def ratio_distribution(spark: SparkSession, folder: str) -> DataFrame:
    both = (F.col("l_discount") > 0) & (F.col("l_tax") > 0)
    return profile.percentiles(lines(spark, folder), F.when(both, F.col("l_discount") / F.nullif(F.col("l_tax"), F.lit(0.0))), [0.1, 0.25, 0.5, 0.75, 0.9], both)


@plans.query("""with c as (select c_nationkey, c_mktsegment v, count(*) n from customer group by 1, 2)
select c_nationkey, v as mode, n from c qualify row_number() over (partition by c_nationkey order by n desc, v) = 1""")
def mode_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return profile.modes(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment")


@plans.query("select source as value, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from documents group by 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(table(spark, folder, "documents"), "source")


SIZES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@plans.query(f"""with {LINES_SQL}, w as (select l_returnflag, p_type, sum(l_quantity) q from li join part on l_partkey = p_partkey group by 1, 2)
select l_returnflag, {', '.join(f'''round(100.0 * coalesce(sum(q) filter (where p_type = '{s}'), 0) / nullif(sum(q), 0), 2) as "{s}"''' for s in SIZES)} from w group by 1""")
def pivot_share(spark: SparkSession, folder: str) -> DataFrame:
    joined = lines(spark, folder).join(table(spark, folder, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return profile.pivot_share(joined, "l_returnflag", "p_type", SIZES, "l_quantity")


@plans.query("""with s as (select pull_id, province_id, upper(trim(regexp_replace(product, '\\s+', ' ', 'g'))) product, sum(value) w from kopdes_province_top_products where value is not null and not isnan(value) and province_id is not null group by all)
select pull_id, province_id, product, round(w, 2) as value, round(100.0 * w / nullif(sum(w) over (partition by pull_id, province_id), 0), 2) as pct from s qualify row_number() over (partition by pull_id, province_id order by w desc, product) = 1""")
def top_item_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kopdes_province_top_products").where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("province_id").isNotNull())
    named = rows.withColumn("product", F.upper(F.trim(F.regexp_replace("product", "\\s+", " "))))
    return profile.top_item(named, ["pull_id", "province_id"], "product", "value")


#: How a product line is sold, by words in its name; the first that occurs decides.
SALE_RULES = [("curah", "loose"), ("karung", "sack"), ("dus", "box"), ("kemasan", "packet"), (" kg", "by weight"), (" ml", "by volume"), (" l", "by volume")]


@plans.query(f"""with c as (select case {' '.join(f"when lower(product) like '%{k}%' then '{v}'" for k, v in SALE_RULES)} else 'other' end category, value from kopdes_province_top_products where product is not null)
select category, count(*) as n, cast(sum(cast(floor(value) as bigint)) as bigint) as value from c where value is not null and not isnan(value) group by 1""")
def category_rules(spark: SparkSession, folder: str) -> DataFrame:
    name = F.lower("product")
    rows = table(spark, folder, "kopdes_province_top_products").where(F.col("product").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    labelled = rows.withColumn("category", first_rule([(name.contains(k), v) for k, v in SALE_RULES], "other"))
    return labelled.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value").cast("decimal(38,0)")).cast("bigint").alias("value"))


@plans.query("""select case when regexp_matches(p_brand, '^Brand#1[0-9]?$') and p_type in ('ECONOMY', 'STANDARD') then 'tier 1' when regexp_matches(p_brand, '^Brand#[12]') then 'tier 2' when p_brand is null then 'unbranded' else 'tier 3' end as tier, count(*) as n, count(distinct p_brand) as brands from part group by 1""")
def brand_tiering(spark: SparkSession, folder: str) -> DataFrame:
    brand = F.col("p_brand")
    tier = first_rule([(brand.rlike("^Brand#1[0-9]?$") & F.col("p_type").isin("ECONOMY", "STANDARD"), "tier 1"), (brand.rlike("^Brand#[12]"), "tier 2"), (brand.isNull(), "unbranded")], "tier 3")
    return table(spark, folder, "part").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


MACRO = {"AFRICA": "west", "AMERICA": "west", "ASIA": "east", "EUROPE": "west"}


@plans.query("""select case r_name when 'AFRICA' then 'west' when 'AMERICA' then 'west' when 'ASIA' then 'east' when 'EUROPE' then 'west' else 'unmapped' end as island, count(*) as customers, count(distinct n_nationkey) as nations
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def island_map_rollup(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(recode(F.col("r_name"), MACRO, "unmapped").alias("island")).agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("n_nationkey").alias("nations"))


@plans.query("""with rates as (select c_nationkey k, 100.0 * avg((c_acctbal > 5000)::int) rate, count(*) n from customer group by 1), w as (select s_nationkey k, count(*) w from supplier group by 1)
select round(sum(rate * n) / sum(n), 4) as crude, round(sum(rate * w) / sum(w), 4) as standardised from rates join w using (k)""")
def standardised_rate(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer").withColumn("k", F.col("c_nationkey"))
    others = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("one"))
    return profile.standardised_rate(people, "k", F.col("c_acctbal") > 5000, others, "one")


@plans.query(f"""with {VILLAGES_SQL} select unnest(['cooperatives', 'accounts_count', 'npwp_count', 'nib_count', 'rat_count', 'simpanan_pokok_tx']) as field, unnest([count(distinct cooperatives), count(distinct accounts_count), count(distinct npwp_count), count(distinct nib_count), count(distinct rat_count), count(distinct simpanan_pokok_tx)]) as n_distinct,
unnest([count(distinct cooperatives) <= 1, count(distinct accounts_count) <= 1, count(distinct npwp_count) <= 1, count(distinct nib_count) <= 1, count(distinct rat_count) <= 1, count(distinct simpanan_pokok_tx) <= 1]) as is_constant from v""")
def constant_fields(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["cooperatives", "accounts_count", "npwp_count", "nib_count", "rat_count", "simpanan_pokok_tx"]
    return profile.constant_fields(villages(spark, folder, *fields), fields)


@plans.query(f"""with {VILLAGES_SQL} select 'savings = pokok + wajib' as "check", count(*) as n_rows, count(*) filter (where savings_total_amount is distinct from simpanan_pokok_amount + simpanan_wajib_amount) as n_broken from v
union all select 'accounts <= cooperatives', count(*), count(*) filter (where (accounts_count <= cooperatives) is distinct from true) from v""")
def integrity_checks(spark: SparkSession, folder: str) -> DataFrame:
    v = villages(spark, folder, "savings_total_amount", "simpanan_pokok_amount", "simpanan_wajib_amount", "accounts_count", "cooperatives")
    return profile.integrity(v, {"savings = pokok + wajib": (F.col("savings_total_amount"), F.col("simpanan_pokok_amount") + F.col("simpanan_wajib_amount")), "accounts <= cooperatives": (F.col("accounts_count") <= F.col("cooperatives"), F.lit(True))})


@plans.query(f"""with {VILLAGES_SQL}, s as (select cooperatives >= 1 a, npwp_count >= 1 b, nib_count >= 1 c, transaction_value > 0 d from v)
select unnest([1, 2, 3, 4]) as step, unnest(['listed', 'tax number', 'licence', 'trading']) as label, unnest([count(*) filter (where a), count(*) filter (where a and b), count(*) filter (where a and b and c), count(*) filter (where a and b and c and d)]) as n from s""")
def compliance_funnel(spark: SparkSession, folder: str) -> DataFrame:
    v = villages(spark, folder, "cooperatives", "npwp_count", "nib_count", "transaction_value")
    return profile.funnel(v, [("listed", F.col("cooperatives") >= 1), ("tax number", F.col("npwp_count") >= 1), ("licence", F.col("nib_count") >= 1), ("trading", F.col("transaction_value") > 0)])


@plans.query("""with c as (select c_nationkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal) - 1 i, count(*) over (partition by c_nationkey) n from customer where c_acctbal is not null)
select c_nationkey, c_acctbal from c where i = least(floor(n * 0.9), n - 1)""")
def nearest_rank_p90(spark: SparkSession, folder: str) -> DataFrame:
    return profile.nearest_rank(table(spark, folder, "customer"), ["c_nationkey"], "c_acctbal", 0.9)


@plans.query("""with s as (select district_id, count(*) n from documents where district_id is not null group by 1), k as (select district_id from s where n >= 0.25 * (select median(n) from s))
select count(*) as n_rows, count(distinct district_id) as n_groups from documents where district_id in (select district_id from k)""")
def dense_scope(spark: SparkSession, folder: str) -> DataFrame:
    return profile.dense_groups(table(spark, folder, "documents").select("district_id"), "district_id", 0.25).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("district_id").alias("n_groups"))


@plans.query(f"""with {VILLAGES_SQL} select round(avg(transaction_volume), 4) as mean, round(stddev_samp(transaction_volume), 4) as std, round(quantile_cont(transaction_volume, 0.05), 4) as p05, round(quantile_cont(transaction_volume, 0.95), 4) as p95, count(transaction_volume) as n from v""")
def envelope_stats(spark: SparkSession, folder: str) -> DataFrame:
    v, x = villages(spark, folder, "transaction_volume"), F.col("transaction_volume")
    one = v.agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.count(x).alias("n"))
    return with_quantiles(one, v, [], {"p05": (x, 0.05), "p95": (x, 0.95)})


@plans.query("""select string_agg(n_name, ', ' order by n_name) as members, n_regionkey, count(*) as n from nation group by n_regionkey""")
def string_aggregation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("members"), F.count(F.lit(1)).alias("n"))


@plans.query(f"""with {VILLAGES_SQL}, a as (select (transaction_value > 0) trades, (savings_total_amount > 0) saves, (rat_count > 0) meets from v)
select unnest(['trades', 'saves', 'meets', 'trades and saves', 'trades and meets', 'all', 'none']) as label, unnest([count(*) filter (where trades), count(*) filter (where saves), count(*) filter (where meets), count(*) filter (where trades and saves), count(*) filter (where trades and meets), count(*) filter (where trades and saves and meets),
count(*) filter (where not coalesce(trades, false) and not coalesce(saves, false) and not coalesce(meets, false))]) as n from a""")
def overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    yes = {k: F.coalesce(F.col(c) > 0, F.lit(False)) for k, c in (("trades", "transaction_value"), ("saves", "savings_total_amount"), ("meets", "rat_count"))}
    t, s, m = yes["trades"], yes["saves"], yes["meets"]
    cells = {"trades": t, "saves": s, "meets": m, "trades and saves": t & s, "trades and meets": t & m, "all": t & s & m, "none": ~t & ~s & ~m}
    return villages(spark, folder, "transaction_value", "savings_total_amount", "rat_count").agg(*[F.count_if(c).alias(k) for k, c in cells.items()]).unpivot([], list(cells), "label", "n")


AGE_EDGES, AGE_LABELS = [0, 500, 2000, 10000, 1e9], ["<500", "500-2k", "2k-10k", ">10k"]


@plans.query("""select case when n_chars > 0 and n_chars <= 500 then '<500' when n_chars > 500 and n_chars <= 2000 then '500-2k' when n_chars > 2000 and n_chars <= 10000 then '2k-10k' when n_chars > 10000 then '>10k' end as band, count(*) as n from documents group by 1""")
def right_closed_bands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(right_closed(F.col("n_chars"), AGE_EDGES, AGE_LABELS).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@plans.query("""with s as (select strftime(o_orderdate, '%Y-%m') as "month", count(*) n, sum(cast(round(o_totalprice * 100) as bigint)) cents from orders group by 1)
select 'orders' as metric, count(*)::double as value from orders union all select 'customers', count(distinct o_custkey)::double from orders union all select 'months', count(*)::double from s union all select 'total', round(sum(cents) / 100.0, 2) from s""")
def headline_block(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    wide = o.agg(F.count(F.lit(1)).cast("double").alias("orders"), F.count_distinct("o_custkey").cast("double").alias("customers"), F.count_distinct(F.date_format("o_orderdate", "yyyy-MM")).cast("double").alias("months"), F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100.0, 2).alias("total"))
    return wide.unpivot([], ["orders", "customers", "months", "total"], "metric", "value")


QUERIES, ORACLE = plans.queries, plans.oracle
