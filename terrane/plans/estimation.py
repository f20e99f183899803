"""Queries on grouped estimates, priors, ranges and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators import estimates as es
from terrane.operators import ranks
from terrane.plans.catalogue import query
from terrane.session import table


def _lines_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))


@query("""SELECT l_suppkey, p_brand, n FROM (SELECT l_suppkey, p_brand, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE r = 1""")
def ag2_top_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es.top_value(_lines_parts(spark, sf_dir), "l_suppkey", "p_brand")


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY p_type) AS BIGINT) AS total, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM c)
SELECT p_type, p_brand, n, total FROM t WHERE r = 1 AND total >= 50 AND n / total >= 0.05""")
def ag4_dominant_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es.dominant_value(_lines_parts(spark, sf_dir), "p_type", "p_brand", 50, 0.05)


_WM = "(SELECT {k}, min(v) AS med, max(tw) AS tw FROM (SELECT {k}, v, tw, sum(w) OVER (PARTITION BY {k} ORDER BY v ROWS UNBOUNDED PRECEDING) AS cw FROM (SELECT {k}, v, sum(q) AS w, sum(sum(q)) OVER (PARTITION BY {k}) AS tw FROM x GROUP BY {k}, v)) WHERE cw >= tw / 2 GROUP BY {k})"
_X = "x AS (SELECT p_partkey, p_brand, p_size, p_type, l_extendedprice AS v, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"WITH {_X} SELECT p_brand, round(med, 2) AS med, round(tw, 1) AS total FROM {_WM.format(k='p_brand')}")
def ag8_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = es.weighted_median(_lines_parts(spark, sf_dir), ["p_brand"], "l_extendedprice", "l_quantity")
    return out.select("p_brand", F.round("med", 2).alias("med"), F.round("total", 1).alias("total"))


@query(f"""WITH {_X}, a AS {_WM.format(k="p_brand, p_size")}, b AS {_WM.format(k="p_brand")}, c AS {_WM.format(k="p_type")}
SELECT p_partkey, round(CASE WHEN a.tw >= 1200 THEN a.med WHEN b.tw >= 50000 THEN b.med ELSE c.med END, 2) AS comps FROM part LEFT JOIN a USING (p_brand, p_size) LEFT JOIN b USING (p_brand) LEFT JOIN c USING (p_type)""")
def an6_comparable_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_parts(spark, sf_dir)
    tables = [(es.weighted_median(rows, keys, "l_extendedprice", "l_quantity"), keys) for keys in (["p_brand", "p_size"], ["p_brand"], ["p_type"])]
    # Fall-back limits differ by level here: the second level needs a weight of 50,000.
    second = tables[1][0].where("total >= 50000")
    out = es.with_fallback(table(spark, sf_dir, "part"), [tables[0], (second, ["p_brand"]), tables[2]], "med", "total", 1200, "comps")
    return out.select("p_partkey", F.round("comps", 2).alias("comps"))


@query("""SELECT p_brand, round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(quantile_cont(l_extendedprice, 0.99), 4) AS high, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def ag9_quantile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = es.quantile_bounds(_lines_parts(spark, sf_dir), ["p_brand"], "l_extendedprice", 0.01, 0.99)
    return out.select("p_brand", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity, l_extendedprice, ln(l_extendedprice / l_quantity) AS v FROM lineitem),
a AS (SELECT l_suppkey, quantile_cont(v, 0.1) - ln(1.1) AS lo, quantile_cont(v, 0.9) + ln(1.1) AS hi, count(*) AS n FROM x GROUP BY 1), s AS (SELECT l_returnflag, quantile_cont(v, 0.1) - ln(1.1) AS slo, quantile_cont(v, 0.9) + ln(1.1) AS shi FROM x GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(least(greatest(v, CASE WHEN n >= 550 THEN lo ELSE slo END), CASE WHEN n >= 550 THEN hi ELSE shi END), 6) AS clipped FROM x JOIN a USING (l_suppkey) JOIN s USING (l_returnflag)""")
def an7_plausibility_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice").withColumn("v", F.ln(F.col("l_extendedprice") / F.col("l_quantity")))
    own = es.quantile_bounds(rows, ["l_suppkey"], "v", 0.1, 0.9)
    wide = es.quantile_bounds(rows, ["l_returnflag"], "v", 0.1, 0.9).select("l_returnflag", F.col("low").alias("wide_low"), F.col("high").alias("wide_high"))
    slack = F.ln(F.lit(1.1))
    low = F.when(F.col("n") >= 550, F.col("low")).otherwise(F.col("wide_low")) - slack
    high = F.when(F.col("n") >= 550, F.col("high")).otherwise(F.col("wide_high")) + slack
    return rows.join(own, "l_suppkey").join(wide, "l_returnflag").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.round(F.least(F.greatest("v", low), high), 6).alias("clipped"))


_P = "x AS (SELECT o_orderkey, o_orderkey % 5 AS fold, r_regionkey AS region, n_nationkey AS nation, c_custkey AS cust, o_totalprice / 1000 AS y, 1.0 AS w FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _prior_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return orders.select("o_orderkey", (F.col("o_orderkey") % 5).alias("fold"), "region", F.col("n_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), (F.col("o_totalprice") / 1000).alias("y"), F.lit(1.0).alias("w"))


@query(f"""WITH {_P}, r AS (SELECT region, sum(w * y) / sum(w) AS p0 FROM x GROUP BY 1), n AS (SELECT nation, sum(w * y) AS wy, sum(w) AS ws FROM x GROUP BY 1), c AS (SELECT cust, sum(w * y) AS cwy, sum(w) AS cw FROM x GROUP BY 1)
SELECT DISTINCT cust, round(p0, 4) AS prior_region, round((wy + 20 * p0) / (ws + 20), 4) AS prior_nation, round((cwy + 20 * ((wy + 20 * p0) / (ws + 20))) / (cw + 20), 4) AS prior_cust, CASE WHEN cw >= 12 THEN 2 WHEN ws >= 500 THEN 1 ELSE 0 END AS level FROM x JOIN r USING (region) JOIN n USING (nation) JOIN c USING (cust)""")
def an3_shrunken_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = es.shrunken_priors(_prior_rows(spark, sf_dir), ["region", "nation", "cust"], "y", "w", 20.0)
    level = F.when(F.col("n_cust") >= 12, 2).when(F.col("n_nation") >= 500, 1).otherwise(0)
    return out.select("cust", *[F.round(f"prior_{c}", 4).alias(f"prior_{c}") for c in ("region", "nation", "cust")], level.alias("level")).distinct()


def _oof(level: str, key: str) -> str:
    return f"{level} AS (SELECT DISTINCT {key}, fold, sum(w * y) OVER (PARTITION BY {key}) - sum(w * y) OVER (PARTITION BY {key}, fold) AS {level}_wy, sum(w) OVER (PARTITION BY {key}) - sum(w) OVER (PARTITION BY {key}, fold) AS {level}_w FROM x)"


@query(f"""WITH {_P}, {_oof("r", "region")}, {_oof("n", "nation")}, {_oof("c", "cust")}, a AS (SELECT o_orderkey, r_wy / r_w AS p0, n_wy, n_w, c_wy, c_w FROM x JOIN r USING (region, fold) JOIN n USING (nation, fold) JOIN c USING (cust, fold))
SELECT o_orderkey, round((n_wy + 20 * p0) / (n_w + 20), 4) AS prior_nation, round((c_wy + 20 * ((n_wy + 20 * p0) / (n_w + 20))) / (c_w + 20), 4) AS prior_cust FROM a""")
def an4_out_of_fold_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = es.shrunken_priors(_prior_rows(spark, sf_dir), ["region", "nation", "cust"], "y", "w", 20.0, "fold")
    return out.select("o_orderkey", F.round("prior_nation", 4).alias("prior_nation"), F.round("prior_cust", 4).alias("prior_cust"))


_E = "e AS (SELECT p_brand AS segment, round(abs(l_extendedprice / l_quantity - p_retailprice), 4) AS err FROM lineitem JOIN part ON p_partkey = l_partkey)"
_RANK = "list_sort(list(err))[CAST(ceil((count(*) + 1) * {a}) AS BIGINT)]"


@query(f"""WITH {_E}, p AS (SELECT {_RANK.format(a=0.8)} AS q80, {_RANK.format(a=0.95)} AS q95 FROM e), s AS (SELECT segment, count(*) AS n, {_RANK.format(a=0.8)} AS q80, {_RANK.format(a=0.95)} AS q95 FROM e GROUP BY segment)
SELECT segment, n, CASE WHEN n >= 2400 THEN s.q80 ELSE p.q80 END AS q80, CASE WHEN n >= 2400 THEN s.q95 ELSE p.q95 END AS q95 FROM s, p""")
def an8_conformal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_parts(spark, sf_dir).select(F.col("p_brand").alias("segment"), F.round(F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")), 4).alias("err"))
    return es.conformal_quantiles(rows, "segment", "err", {"q80": 1 - 0.8, "q95": 1 - 0.95}, 2400).select("segment", "n", "q80", "q95")


@query("""SELECT l_returnflag AS segment, round(avg(CASE WHEN l_extendedprice BETWEEN p_retailprice * 10 AND p_retailprice * 40 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def an9_interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("l_extendedprice").between(F.col("p_retailprice") * 10, F.col("p_retailprice") * 40)
    return _lines_parts(spark, sf_dir).groupBy(F.col("l_returnflag").alias("segment")).agg(F.round(F.avg(inside.cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT l_returnflag, p_brand, l_extendedprice AS a, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_returnflag, p_brand, round(median(abs(p - a) / a), 6) AS mdape, round(avg(CASE WHEN abs(p - a) / a <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS ppe10, round(avg(CASE WHEN abs(p - a) / a <= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS ppe20, round(sqrt(avg(pow(ln(p) - ln(a), 2))), 6) AS rmse_log, count(*) AS n
FROM m GROUP BY GROUPING SETS ((), (l_returnflag), (p_brand))""")
def ag20_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_parts(spark, sf_dir).select("l_returnflag", "p_brand", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    out = es.error_metrics(rows, "a", "p", [[], ["l_returnflag"], ["p_brand"]])
    return out.select("l_returnflag", "p_brand", *[F.round(c, 6).alias(c) for c in ("mdape", "ppe10", "ppe20", "rmse_log")], "n")


@query("""WITH m AS (SELECT unnest(list_filter(['all', CASE WHEN l_quantity > 25 THEN 'large' END, CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS segment, abs(l_quantity * 1500 - l_extendedprice) / l_extendedprice AS ape FROM lineitem)
SELECT segment, count(*) AS n, round(avg(ape), 6) AS mape, round(median(ape), 6) AS mdape FROM m GROUP BY segment""")
def ag21_overlapping_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(F.lit("all"), F.when(F.col("l_quantity") > 25, "large"), F.when(F.col("l_discount") > 0.05, "discounted"), F.when(F.col("l_returnflag") == "R", "returned"))
    ape = F.abs(F.col("l_quantity") * 1500 - F.col("l_extendedprice")) / F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.explode(labels).alias("segment"), ape.alias("ape")).where("segment is not null")
    means = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ape"), 6).alias("mape"))
    medians = ranks.quantiles(rows, ["segment"], "ape", {"mdape": 0.5}).drop("n")
    return means.join(medians, "segment", "left").select("segment", "n", "mape", F.round("mdape", 6).alias("mdape"))


_C = "c AS (SELECT doc_id, lang, quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p, n_chars AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), F.col("n_chars").alias("score"))


@query(f"""WITH {_C} SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1
FROM (SELECT lang, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM c GROUP BY lang)""")
def ag22_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = es.binary_metrics(_scored(spark, sf_dir), F.col("y"), F.col("score") > 800, ["lang"])
    return out.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_C}, r AS (SELECT y, sum(y) OVER w AS hits, row_number() OVER w AS rank, sum(y) OVER () AS total FROM c WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT round(sum(CASE WHEN y = 1 THEN hits / rank ELSE 0 END) / max(total), 6) AS average_precision, count(*) AS n FROM r""")
def ag23_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = es.precision_recall(_scored(spark, sf_dir), "y", "score", "doc_id")
    return rows.agg(F.round(F.sum(F.when(F.col("y") == 1, F.col("precision")).otherwise(0.0)) / F.sum("y"), 6).alias("average_precision"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_C} SELECT cut, count(*) FILTER (score >= cut) AS flagged, count(*) FILTER (score >= cut AND y = 1) AS tp, round(count(*) FILTER (score >= cut AND y = 1) / nullif(count(*) FILTER (score >= cut), 0), 6) AS "precision", round(count(*) FILTER (score >= cut AND y = 1) / sum(y), 6) AS recall
FROM c, (VALUES (100), (500), (1000), (2000), (4000), (1000000)) t(cut) GROUP BY cut""")
def ag24_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = [100, 500, 1000, 2000, 4000, 1000000]
    rows = _scored(spark, sf_dir).select("y", "score", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    flagged, tp = F.count_if(F.expr("score >= cut")), F.count_if(F.expr("score >= cut and y = 1"))
    return rows.groupBy("cut").agg(flagged.alias("flagged"), tp.alias("tp"), F.round(F.try_divide(tp, flagged), 6).alias("precision"), F.round(F.try_divide(tp, F.sum("y")), 6).alias("recall"))


@query(f"""WITH {_C}, r AS (SELECT score, doc_id, sum(y) OVER w / row_number() OVER w AS prec FROM c WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT CAST(min(score) AS BIGINT) AS threshold, count(*) AS n FROM r WHERE prec >= 0.9""")
def an22_threshold_at_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = es.precision_recall(_scored(spark, sf_dir), "y", "score", "doc_id").where("precision >= 0.9")
    return rows.agg(F.min("score").cast("long").alias("threshold"), F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) AS bulk, CAST((SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - CAST(o_orderdate AS DATE) AS INTEGER) AS age FROM orders)
SELECT o_orderkey, bulk, round(pow(0.5, age / 365.0) / bulk, 8) AS weight FROM g""")
def ag15_ag16_bulk_recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max(F.to_date("o_orderdate")).alias("last"))
    sizes = orders.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("bulk"))
    rows = orders.join(sizes, ["o_custkey", "o_orderstatus", "o_orderpriority"]).join(F.broadcast(last))
    return rows.select("o_orderkey", "bulk", F.round(es.recency_weight(F.datediff("last", F.to_date("o_orderdate")), 365.0, F.col("bulk")), 8).alias("weight"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN n_chars IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS n_chars, round(avg(CASE WHEN toxic IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def ag25_feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(c)
    return rows.agg(F.count(F.lit(1)).alias("n"), share("n_chars"), share("toxic"))


@query("SELECT c_nationkey, n FROM (SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY n DESC, c_nationkey LIMIT 10")
def ag26_top_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(10)


@query("""SELECT o_custkey, min(o_totalprice) AS low, count(DISTINCT o_orderpriority) AS kinds, bool_or(o_orderstatus = 'P') AS any_pending, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources, list_sort(list(o_orderkey))[1:3] AS firsts FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 1.5 * min(o_totalprice) AND count(*) >= 5""")
def ag10_ag13_group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("sources"), F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 3).alias("firsts"))
    return out.where("high > 1.5 * low and n >= 5").select("o_custkey", "low", "kinds", "any_pending", "sources", "firsts")


@query("""SELECT p_brand, p_type, p_size, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""")
def ag3_ag19_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_parts(spark, sf_dir).groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("l_returnflag = 'R'")).alias("returned"))


@query("""WITH f AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000), t AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT (SELECT count(*) FROM f) AS flagged, (SELECT count(*) FROM t) AS truth, (SELECT count(*) FROM f JOIN t USING (o_orderkey)) AS hit, (SELECT count(*) FROM t ANTI JOIN f USING (o_orderkey)) AS missed""")
def se5_flag_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 200000).alias("f"), (F.col("o_orderpriority") == "1-URGENT").alias("t"))
    return marks.agg(F.count_if("f").alias("flagged"), F.count_if("t").alias("truth"), F.count_if(F.expr("f and t")).alias("hit"), F.count_if(F.expr("t and not f")).alias("missed"))


@query("""WITH m AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT o_orderkey, o_totalprice FROM m WHERE r <= 4""")
def prj19_stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority", "o_orderstatus").orderBy(F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 4").select("o_orderkey", "o_totalprice")
