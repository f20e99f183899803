"""Queries on fitted models and resampling: rows only, SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import learning
from terrane.operators.contributions import with_contributions
from terrane.operators.evaluation import drivers
from terrane.operators.tuning import tuned
from terrane.operators import timeseries as ts
from terrane.plans.catalogue import query
from terrane.plans.similarity import an19_jn6_pair_features
from terrane.products import listings
from terrane.products.areas import AreaStats
from terrane.products.forecast import Forecaster
from terrane.products.price import PricePredictor
from terrane.products.scoring import rescored
from terrane.products.search import search
from terrane.session import cut, table


@query()
def an21_an23_pair_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs scored by a fitted model, with and without the price feature."""
    rows = an19_jn6_pair_features(spark, sf_dir)
    rows = rows.select("a", "b", "price_gap", F.col("same_brand").cast("double").alias("same_brand"), F.col("size_apart").cast("double").alias("size_apart"), (F.col("sources") == "order").cast("int").alias("label"))
    rows = cut(rows, "pairs")
    model = learning.fit_pair_model(rows, ["price_gap", "same_brand", "size_apart"], "label")
    blind = learning.pair_scores(model, rows, "price_gap").select("a", "b", F.round("score", 4).alias("blind"))
    return learning.pair_scores(model, rows).select("a", "b", F.round("score", 4).alias("score")).join(blind, ["a", "b"])


@query()
def an38_boosted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = cut(lines.select("l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("q"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("p"), (F.col("l_orderkey") % 5 == 0).alias("check")), "rows")
    model = learning.fit_boosted(rows, ["q", "s", "p"], "y", validation="check", trees=5, depth=4)
    return learning.predict(model, rows, "fitted").where("check").agg(F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("fitted"), 2))), 4).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query()
def an38_tuned_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over depth, step and trees of the model of an38, and its refit."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = cut(lines.select("l_orderkey", F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("q"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("p"), (F.col("l_orderkey") % 5 == 0).alias("check")), "rows")
    found = tuned(rows, ["q", "s", "p"], "y", "check", {"depth": (2, 4), "trees": (2, 6), "step": (0.05, 0.5)}, trials=5, startup=3)
    error = learning.predict(found.model, rows, "fitted").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("fitted"), 2))).alias("refit_rmse"))
    return error.select(F.lit(len(found.trials)).alias("trials"), F.round(F.lit(found.trials[0][1]), 6).alias("first_rmse"), F.round(F.lit(found.best_error), 6).alias("best_rmse"), F.lit(int(found.best["depth"])).alias("depth"), F.round("refit_rmse", 4).alias("refit_rmse"))


@query()
def an39_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the price of each line, and the three that add most."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = cut(lines.select("l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("q"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("p")), "rows")
    model = learning.fit_boosted(rows, ["q", "s", "p"], "y", trees=5, depth=4)
    told = with_contributions(model, learning.predict(model, rows, "fitted"), ["q", "s", "p"])
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["value"])
    return told.select("l_orderkey", "l_linenumber", "fitted", "base_value", (total - F.col("fitted")).alias("gap"), drivers(F.col("contributions"), 3, 0.001).alias("drivers"))


@query()
def an37_pointwise_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointwise ranker on grades, in place of a listwise learner that Spark ML does not have."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = cut(docs.select("doc_id", F.col("source").alias("query"), (2 * F.col("quality") + 1 - F.col("toxic")).cast("double").alias("grade"), F.ln(F.col("n_chars") + 1.0).alias("length"), F.size(F.split("text", "\n")).cast("double").alias("lines")), "graded")
    model = learning.fit_boosted(rows, ["length", "lines"], "grade", trees=5, depth=3)
    from terrane.operators.retrieval import ranked, ranking_metrics

    scored = ranked(learning.predict(model, rows, "score"), "query", F.col("score"), "doc_id")
    return ranking_metrics(scored.withColumn("grade", F.col("grade").cast("int")), "query", "grade", 10, good=3)


@query()
def an37_listwise_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of a listwise and a pointwise ranker on every third source, fitted on the others."""
    from terrane.operators import ranking
    from terrane.operators.retrieval import ranked, ranking_metrics

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    upper = F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]", ""))
    rows = docs.select("doc_id", F.col("source").alias("query"), (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"), F.ln(F.col("n_chars") + 1.0).alias("length"), F.size(F.split("text", "\n")).cast("double").alias("lines"), (upper / (F.col("n_chars") + 1)).alias("shouted"))
    rows, features = cut(rows, "graded"), ["length", "lines", "shouted"]
    is_held = F.pmod(F.crc32(F.col("query")), F.lit(3)) == 0
    train, held = rows.where(~is_held), rows.where(is_held)
    listwise = ranking.with_scores(ranking.fit_listwise(train, "query", "doc_id", "grade", features, trees=3, depth=3), held)
    pointwise = learning.predict(learning.fit_boosted(train.withColumn("grade", F.col("grade").cast("double")), features, "grade", trees=3, depth=3), held, "score")
    metrics = [ranking_metrics(ranked(scored, "query", F.col("score"), "doc_id"), "query", "grade", 10, good=3).withColumn("model", F.lit(name)) for name, scored in (("listwise", listwise), ("pointwise", pointwise))]
    return metrics[0].unionByName(metrics[1])


@query()
def an15_bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.bootstrap_mean(table(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice", 100)


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.select(F.split("p_type", " ")[0].alias("kind"), F.col("p_brand").alias("area"), F.concat_ws("-", "p_brand", "p_size").alias("project"), F.col("p_partkey").cast("string").alias("building"), F.col("l_returnflag").alias("segment"), F.lit("all").alias("pool"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("price"))


@query()
def api_price_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates with ranges for the newest sales, from a predictor fitted on all."""
    sales = cut(_sales(spark, sf_dir), "sales")
    asked = sales.where(F.year("day") >= 2001).drop("price").distinct()
    return PricePredictor().fit(sales).predict(asked)


@query("""WITH s AS (SELECT split_part(p_type, ' ', 1) AS kind, p_brand AS area, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey), e AS (SELECT max(day) AS last FROM s),
r AS (SELECT *, day > last - INTERVAL 12 MONTH AS n, day <= last - INTERVAL 12 MONTH AND day > last - INTERVAL 24 MONTH AS b FROM s, e)
SELECT area, kind, count(*) FILTER (n) AS sales, median(price) FILTER (n) AS "now", median(price) FILTER (b) AS "before", median(price) FILTER (n) / nullif(median(price) FILTER (b), 0) - 1 AS change FROM r GROUP BY 1, 2 HAVING count(*) FILTER (n) >= 5""")
def api_area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AreaStats(_sales(spark, sf_dir)).summary()


@query()
def an28_api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text queries over documents that stand in for listings."""
    docs = table(spark, sf_dir, "documents")
    listings = docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 5).cast("int").alias("bedrooms"), (F.col("n_chars") * 1000.0).alias("price"), F.when(F.col("lang") == "en", "flat").otherwise("villa").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("posted"), F.concat_ws("-", "source", F.col("doc_id") % 7).alias("cluster"))
    asked = spark.createDataFrame([(1, "2 bed flat under 2m the ention"), (2, "villa over 500k with der und"), (3, "studio below 1.5 million"), (4, "que de la 3br")], "query int, text string")
    return search(listings, asked)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, o_totalprice AS price FROM orders), m AS (SELECT max(day) + 1 AS t FROM o), q AS (SELECT DISTINCT o_custkey, t AS day FROM o, m)
SELECT q.o_custkey, CAST(q.day AS INTEGER) AS day, count(o.price) AS n, median(o.price) AS base FROM q LEFT JOIN o ON o.o_custkey = q.o_custkey AND o.day BETWEEN q.day - 365 AND q.day - 1 GROUP BY 1, 2""")
def an17_prj12_serving_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every customer the day after the data end, from rows without a value that join the history."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", ts.day_number("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))
    asked = orders.select("o_custkey").distinct().join(F.broadcast(orders.agg((F.max("day") + 1).alias("day")))).withColumn("asked", F.lit(True))
    rows = ts.rolling_stats(orders.unionByName(asked, allowMissingColumns=True), ["o_custkey"], "day", "price", {"year": (-365, -1)})
    return rows.where("asked").select("o_custkey", "day", F.col("year_n").alias("n"), F.col("year_median").alias("base"))


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, o_totalprice AS p FROM orders), b AS (SELECT o_custkey, max(CASE WHEN y = 1999 THEN p END) AS now, max(CASE WHEN y = 1998 THEN p END) AS last FROM o GROUP BY 1)
SELECT o_custkey, coalesce(round(ln(now / last), 6), 0.0) AS trend, CASE WHEN abs(ln(now / last)) <= 0.1 THEN 'high' WHEN abs(ln(now / last)) <= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def an10_an14_baseline_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(y == 1999, F.col("o_totalprice"))).alias("now"), F.max(F.when(y == 1998, F.col("o_totalprice"))).alias("last"))
    trend = F.ln(F.col("now") / F.col("last"))
    return b.select("o_custkey", F.coalesce(F.round(trend, 6), F.lit(0.0)).alias("trend"), F.when(F.abs(trend) <= 0.1, "high").when(F.abs(trend) <= 0.5, "medium").otherwise("low").alias("confidence"))


@query()
def api_forecaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth per supplier and part type: forecasts where a gate passes, else the reason."""
    lines = table(spark, sf_dir, "lineitem")
    sales = lines.select(F.concat_ws("-", F.lit("area"), F.col("l_suppkey") % 20).alias("area"), F.col("l_suppkey").cast("string").alias("building"), F.col("l_returnflag").alias("kind"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("price"))
    sales = cut(sales, "sales")
    return Forecaster().fit(sales).forecast(sales)


@query()
def api_listing_checker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by a fitted pair model over candidates of vectors that stand in for listings."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (1000.0 + F.col("label") * 100).alias("price"), (50.0 + F.col("vec_id") % 40).alias("size"), F.col("label").alias("area"), (F.col("vec_id") % 7).alias("agent"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 90).cast("int")).alias("posted"))
    rows = cut(rows, "listings")
    photos = rows.select("id", F.concat_ws("-", "area", "agent", "posted").alias("photo"))
    features = cut(listings.pair_features(listings.candidates(rows, photos, 5, 8), rows).withColumn("label", (F.col("cosine") > 0.35).cast("int")), "features")
    return listings.ListingChecker.fit(features, "label").duplicates(features).select("a", "b", F.round("score", 4).alias("score"))


@query()
def an50_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over all parts: the first scores all, the second none, the third those whose price has changed."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    score = lambda rows: rows.withColumn("score", F.when(F.col("p_size") > 1, F.ln(F.col("p_retailprice") / F.col("p_size"))))
    raised = part.withColumn("p_retailprice", F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") * 1.1).otherwise(F.col("p_retailprice")))
    last, out = None, []
    for run, rows in enumerate((part, part, raised), 1):
        last, counts = rescored(rows, last, "p_partkey", ["p_size", "p_retailprice"], "v1", score)
        out.append((run, *counts.values()))
    return spark.createDataFrame(out, "run int, total long, scored long, kept long, unscorable long")
