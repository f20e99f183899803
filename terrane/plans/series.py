"""Queries on date windows, as-of features and month indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators import timeseries as ts
from terrane.plans.catalogue import query
from terrane.session import cut, table


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", ts.day_number("l_shipdate").alias("day"), F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double").alias("ppu"))


_D = "d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day, floor(l_extendedprice * 100 / l_quantity) AS ppu FROM lineitem)"


def _frame(low: int, high: int) -> str:
    side = lambda x: f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"OVER (PARTITION BY l_suppkey ORDER BY day RANGE BETWEEN {side(low)} AND {side(high)})"


@query(f"""WITH {_D}, w AS (SELECT *, median(ppu) {_frame(-92, -1)} AS base, count(ppu) {_frame(-92, -1)} AS n_base, median(ppu) {_frame(76, 107)} AS ahead, count(ppu) {_frame(76, 107)} AS n_ahead FROM d)
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, day, round(base, 4) AS base, n_base, round(ahead, 4) AS ahead, n_ahead,
CASE WHEN n_base < 5 THEN 'no_base' WHEN n_ahead < 5 THEN 'no_target' ELSE 'usable' END AS status, CASE WHEN n_base >= 5 AND n_ahead >= 5 THEN round(ln(ahead / base), 5) END AS growth FROM w""")
def wn4_wn6_growth_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.rolling_stats(_daily(spark, sf_dir), ["l_suppkey"], "day", "ppu", {"base": (-92, -1), "ahead": (76, 107)})
    enough = (F.col("base_n") >= 5) & (F.col("ahead_n") >= 5)
    status = F.when(F.col("base_n") < 5, "no_base").when(F.col("ahead_n") < 5, "no_target").otherwise("usable")
    growth = F.when(enough, F.round(F.ln(F.col("ahead_median") / F.col("base_median")), 5))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "day", F.round("base_median", 4).alias("base"), F.col("base_n").alias("n_base"), F.round("ahead_median", 4).alias("ahead"), F.col("ahead_n").alias("n_ahead"), status.alias("status"), growth.alias("growth"))


@query(f"""WITH {_D}, w AS (SELECT *, median(ppu) {_frame(-92, -1)} AS now, count(ppu) {_frame(-92, -1)} AS n_now, median(ppu) {_frame(-457, -366)} AS lagged, count(ppu) {_frame(-457, -366)} AS n_lagged, count(ppu) {_frame(-365, -1)} AS n_year FROM d)
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, day, n_year, CASE WHEN n_now >= 5 AND n_lagged >= 5 THEN round(ln(now / lagged), 5) END AS momentum FROM w""")
def wn7_wn8_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.rolling_stats(_daily(spark, sf_dir), ["l_suppkey"], "day", "ppu", {"now": (-92, -1), "lagged": (-457, -366)}, {"year": (-365, -1)})
    momentum = F.when((F.col("now_n") >= 5) & (F.col("lagged_n") >= 5), F.round(F.ln(F.col("now_median") / F.col("lagged_median")), 5))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "day", F.col("year_n").alias("n_year"), momentum.alias("momentum"))


@query(f"""WITH {_D}, w AS (SELECT *, count(ppu) {_frame(-92, -1)} AS n_own, median(ppu) {_frame(-92, -1)} AS own, median(ppu) OVER (PARTITION BY l_returnflag ORDER BY day RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS wide FROM d)
SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, day, CASE WHEN n_own >= 25 THEN 'own' ELSE 'wide' END AS level, round(CASE WHEN n_own >= 25 THEN own ELSE wide END, 4) AS base FROM w""")
def wn5_base_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.rolling_stats(_daily(spark, sf_dir), ["l_suppkey"], "day", "ppu", {"own": (-92, -1)})
    rows = ts.rolling_stats(cut(rows, "own"), ["l_returnflag"], "day", "ppu", {"wide": (-20, -1)})
    own = F.col("own_n") >= 25
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "day", F.when(own, "own").otherwise("wide").alias("level"), F.round(F.when(own, F.col("own_median")).otherwise(F.col("wide_median")), 4).alias("base"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day FROM orders)
SELECT o_orderkey, day - max(day) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS days_since FROM o""")
def jn9_days_since_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", ts.day_number("o_orderdate").cast("long").alias("day"))
    return orders.select("o_orderkey", ts.days_since_previous(["o_custkey"], "day").alias("days_since"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'),
u AS (SELECT o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS uday, max(o_totalprice) AS price FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT o_orderkey, round(u.price, 2) AS previous_price FROM o ASOF LEFT JOIN u ON o.o_custkey = u.o_custkey AND o.day > u.uday""")
def jn9_asof_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", ts.day_number("o_orderdate"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("price"))
    rows = orders.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_custkey", "day")
    out = ts.asof_backward(rows, urgent, ["o_custkey"], "day", "day", "price")
    return out.select("o_orderkey", F.round("previous_price", 2).alias("previous_price"))


_MONTHS = "s AS (SELECT l_returnflag || '_' || l_linestatus AS segment, l_returnflag AS pool, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, ln(l_extendedprice / l_quantity) AS v FROM lineitem)"
_PICK = "(SELECT CASE WHEN count(*) >= 30 THEN median(v) END FROM s WHERE {key} = g.{key} AND s.m BETWEEN g.m - {w} AND g.m - 1)"


@query(f"""WITH {_MONTHS}, g AS (SELECT segment, pool, unnest(range(23952, 24000)) AS m FROM (SELECT DISTINCT segment, pool FROM s)),
c AS (SELECT segment, m, {", ".join(f"{_PICK.format(key=k, w=w)} AS {k}_{w}" for k in ("segment", "pool") for w in (3, 6, 12))} FROM g),
p AS (SELECT segment, m, coalesce(segment_3, segment_6, segment_12, pool_3, pool_6, pool_12) AS own,
CASE WHEN segment_3 IS NOT NULL THEN 'segment_3' WHEN segment_6 IS NOT NULL THEN 'segment_6' WHEN segment_12 IS NOT NULL THEN 'segment_12' WHEN pool_3 IS NOT NULL THEN 'pooled_3' WHEN pool_6 IS NOT NULL THEN 'pooled_6' WHEN pool_12 IS NOT NULL THEN 'pooled_12' END AS src FROM c),
k AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY segment ORDER BY m ROWS UNBOUNDED PRECEDING) AS carried FROM p)
SELECT segment, CAST(m AS INTEGER) AS month, round(carried, 5) AS value, CASE WHEN src IS NOT NULL THEN src WHEN carried IS NOT NULL THEN 'carried' END AS source FROM k""")
def wn12_month_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sales = lines.select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("segment"), F.col("l_returnflag").alias("pool"), ts.month_number("l_shipdate").alias("m"), F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    out = ts.month_index(sales, "segment", "pool", "m", "v", 23952, 23999, 30)
    return out.select("segment", "month", F.round("value", 5).alias("value"), "source")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS after_next,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS position FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def wn10_wn11_running_and_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.lead("o_totalprice", 2).over(w), 2).alias("after_next"), (F.row_number().over(w) - 1).alias("position"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - f.first AS INTEGER) AS age, o_orderdate::DATE > f.first AS earlier FROM orders JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY 1) f USING (o_custkey)""")
def wn9_first_sale_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    first = orders.groupBy("o_custkey").agg(F.min("d").alias("first"))
    return orders.join(first, "o_custkey").select("o_orderkey", F.datediff("d", "first").alias("age"), (F.col("d") > F.col("first")).alias("earlier"))


_IV = "iv AS (SELECT o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS opened, max(CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS closed, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, 2, o_orderpriority)"


@query(f"""WITH {_IV}, r AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS t0 FROM orders)
SELECT o_orderkey, CAST(count(*) FILTER (opened <= t0 AND closed > t0) AS BIGINT) AS n_open, CAST(count(DISTINCT CASE WHEN opened <= t0 AND closed > t0 THEN o_orderpriority END) AS BIGINT) AS n_kinds,
CAST(min(CASE WHEN opened <= t0 AND closed > t0 THEN closed - t0 END) AS INTEGER) AS days_to_next, CAST(count(*) FILTER (closed <= t0 AND closed > t0 - 730) AS BIGINT) AS n_ended FROM r LEFT JOIN iv USING (o_custkey) GROUP BY o_orderkey, o_custkey, t0""")
def jn12_an12_open_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", ts.day_number("o_orderdate").alias("at"), "o_orderpriority")
    closed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(ts.day_number("l_shipdate")).alias("closed"))
    intervals = orders.join(closed, "o_orderkey").select("o_custkey", F.col("at").alias("opened"), "closed", "o_orderpriority")
    out = ts.interval_features(orders.select("o_orderkey", "o_custkey", "at"), intervals, "o_custkey", "at", "opened", "closed", "o_orderpriority")
    return out.select("o_orderkey", "n_open", "n_kinds", "days_to_next", "n_ended")


@query("""WITH o AS (SELECT c_nationkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT n_name, count(*) FILTER (d > last - INTERVAL 12 MONTH) AS sales, round(median(o_totalprice) FILTER (d > last - INTERVAL 12 MONTH), 3) AS now, round(median(o_totalprice) FILTER (d <= last - INTERVAL 12 MONTH AND d > last - INTERVAL 24 MONTH), 3) AS before
FROM o JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) FILTER (d > last - INTERVAL 12 MONTH) >= 5""")
def ag17_area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("d"))
    last = orders.agg(F.max("d").alias("last"))
    rows = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey").join(F.broadcast(last))
    now = F.col("d") > F.add_months("last", -12)
    before = ~now & (F.col("d") > F.add_months("last", -24))
    out = rows.groupBy("n_name").agg(F.count_if(now).alias("sales"), F.round(F.median(F.when(now, F.col("o_totalprice"))), 3).alias("now"), F.round(F.median(F.when(before, F.col("o_totalprice"))), 3).alias("before"))
    return out.where("sales >= 5")


@query("""SELECT n_name, c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS sales, CASE WHEN count(*) >= 5 THEN round(median(o_totalprice), 3) END AS median_price
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3""")
def ag18_area_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    n = F.count(F.lit(1))
    return rows.groupBy("n_name", "c_mktsegment", F.trunc("o_orderdate", "month").alias("month")).agg(n.alias("sales"), F.when(n >= 5, F.round(F.median("o_totalprice"), 3)).alias("median_price"))
