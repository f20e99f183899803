"""Queries on ordered rules, outliers, repeated rows and problem lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators import rules
from terrane.plans.catalogue import query
from terrane.session import table

TIERS = [["l_suppkey", "l_returnflag", "l_linestatus", "year"], ["l_suppkey", "l_returnflag", "year"], ["l_returnflag", "l_linestatus", "year"], ["l_returnflag", "year"], ["l_returnflag"]]

#: What tiers need of a row.
PEERS = [*dict.fromkeys(k for tier in TIERS for k in tier), "x"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return lines.withColumns({"year": F.year("l_shipdate"), "x": F.ln(F.col("l_extendedprice") / F.col("l_quantity"))})


ORDER = ["l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("repeat", rules.is_repeat(["l_orderkey", "l_linenumber"], ORDER))
    reason = rules.first_match([("repeated_line", F.col("repeat")), ("no_discount", F.col("l_discount") == 0), ("invalid_quantity", F.col("l_quantity").isNull() | (F.col("l_quantity") <= 0)), ("price_below_floor", F.col("l_extendedprice") < 1000)])
    return rows.withColumn("rule", reason)


_RULES_SQL = """
lines AS (SELECT *, year(l_shipdate) AS yr, ln(l_extendedprice / l_quantity) AS x,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem),
ruled AS (SELECT *, CASE WHEN rn > 1 THEN 'repeated_line' WHEN l_discount = 0 THEN 'no_discount' WHEN l_quantity IS NULL OR l_quantity <= 0 THEN 'invalid_quantity' WHEN l_extendedprice < 1000 THEN 'price_below_floor' END AS rule FROM lines)"""

_TIER_KEYS = ["l_suppkey, l_returnflag, l_linestatus, yr", "l_suppkey, l_returnflag, yr", "l_returnflag, l_linestatus, yr", "l_returnflag, yr", "l_returnflag"]
_Z_SQL = (
    f"WITH {_RULES_SQL}, clean AS (SELECT * FROM ruled WHERE rule IS NULL), "
    + "m AS (SELECT *, " + ", ".join(f"median(x) OVER (PARTITION BY {k}) AS med{i}, count(x) OVER (PARTITION BY {k}) AS n{i}" for i, k in enumerate(_TIER_KEYS, 1)) + " FROM clean), "
    + "d AS (SELECT *, " + ", ".join(f"median(abs(x - med{i})) OVER (PARTITION BY {k}) AS mad{i}" for i, k in enumerate(_TIER_KEYS, 1)) + " FROM m), "
    + "t AS (SELECT *, CASE " + " ".join(f"WHEN n{i} >= 30 AND mad{i} > 0 THEN {i}" for i in range(1, 6)) + " END AS peer_tier FROM d), "
    + "s AS (SELECT *, (x - CASE " + " ".join(f"WHEN peer_tier = {i} THEN med{i}" for i in range(1, 6)) + " END) / greatest(1.4826 * CASE " + " ".join(f"WHEN peer_tier = {i} THEN mad{i}" for i in range(1, 6)) + " END, 0.12) AS z FROM t) "
)


@query(_Z_SQL + "SELECT l_orderkey, l_linenumber, CAST(peer_tier AS INTEGER) AS peer_tier, round(z, 5) AS robust_z, CASE WHEN z < -1.5 THEN 'low' WHEN z > 1.5 THEN 'high' END AS outlier FROM s")
def an1_tiered_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _classified(spark, sf_dir).where("rule is null").select("l_orderkey", "l_linenumber", *PEERS)
    z = rules.tiered_robust_z(clean, "x", TIERS)
    outlier = rules.first_match([("low", F.col("robust_z") < -1.5), ("high", F.col("robust_z") > 1.5)])
    return z.select("l_orderkey", "l_linenumber", "peer_tier", F.round("robust_z", 5).alias("robust_z"), outlier.alias("outlier"))


@query(_Z_SQL + ", o AS (SELECT CASE WHEN z < -1.5 THEN 'price_outlier_low' WHEN z > 1.5 THEN 'price_outlier_high' ELSE 'clean' END AS reason FROM s UNION ALL SELECT rule FROM ruled WHERE rule IS NOT NULL) SELECT reason, count(*) AS n FROM o GROUP BY reason")
def an1_classify_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One pass: rows that a rule has named have no value, which leaves them out of all medians and counts.
    rows = _classified(spark, sf_dir).withColumn("x", F.when(F.col("rule").isNull(), F.col("x"))).select("rule", *PEERS)
    z = rules.tiered_robust_z(rows, "x", TIERS)
    late = rules.first_match([("price_outlier_low", F.col("robust_z") < -1.5), ("price_outlier_high", F.col("robust_z") > 1.5)])
    return z.select(F.coalesce("rule", late, F.lit("clean")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(_Z_SQL + "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN z < -1.0 AND abs(z + ln(10.7639) / 4) <= 1.0 THEN 'suspected_unit' WHEN z < -1.0 THEN 'outlier_low' WHEN z > 1.0 THEN 'outlier_high' ELSE 'kept' END AS reason FROM s) GROUP BY reason")
def wn3_unit_retest(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rules.tiered_robust_z(_classified(spark, sf_dir).where("rule is null").select(*PEERS), "x", TIERS)
    reason = F.coalesce(rules.outlier_reason(F.col("robust_z"), F.col("robust_z") + F.ln(F.lit(10.7639)) / 4, 1.0), F.lit("kept"))
    return z.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RULES_SQL} SELECT coalesce(rule, 'kept') AS reason, count(*) AS n FROM ruled GROUP BY 1")
def prj15_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select(F.coalesce("rule", F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.status AS status, CAST(count(o_orderkey) AS BIGINT) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def ag1_zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(s,) for s in "FOPX"], "status string")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH b AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, ln(l_extendedprice / l_quantity) AS x FROM lineitem),
m AS (SELECT *, median(x) OVER w AS med, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY l_suppkey, month)),
d AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY l_suppkey, month) AS mad FROM m)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (n >= 10 AND mad > 0 AND abs((x - med) / (1.4826 * mad)) > 2.0) AS n_outlier FROM d GROUP BY l_suppkey""")
def an11_monthly_mad_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("month", F.trunc("l_shipdate", "month"))
    screened = rules.group_mad_screen(rows, "x", ["l_suppkey", "month"], 10, 2.0)
    return screened.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("outlier").alias("n_outlier"))


@query("""SELECT p_partkey, problem FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size < 5 THEN 'size below 5' END, CASE WHEN p_retailprice > 1900 THEN 'price above 1900' END, CASE WHEN p_brand = 'Brand#11' THEN 'brand not allowed' END], lambda x: x IS NOT NULL)) AS problem FROM part)""")
def prj20_problem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.problems([("size below 5", F.col("p_size") < 5), ("price above 1900", F.col("p_retailprice") > 1900), ("brand not allowed", F.col("p_brand") == "Brand#11")])
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("problem"))


@query("""SELECT l_suppkey, l_shipdate::DATE AS day, l_orderkey, l_linenumber, l_quantity, CAST(rn AS INTEGER) AS position FROM (
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_partkey DESC, l_discount DESC, l_tax DESC) AS rn FROM lineitem) WHERE rn <= 3""")
def ag14_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_discount", "l_tax"]
    w = Window.partitionBy("l_suppkey").orderBy(*[F.desc(k) for k in keys])
    return table(spark, sf_dir, "lineitem").withColumn("position", F.row_number().over(w)).where("position <= 3").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_quantity", "position")
