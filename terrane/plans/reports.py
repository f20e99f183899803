"""Queries on listing flags, evaluations, samples, name variants and the ledger of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scalars as sc
from terrane.operators import evaluation as ev
from terrane.plans.catalogue import query
from terrane.products import generator
from terrane.products import listings
from terrane.session import cut, table
from terrane.sources import sinks

_L = "l AS (SELECT p_partkey AS id, p_retailprice AS price, p_size % 10 AS area, p_brand || '-' || (p_partkey % 4) AS photo, p_partkey // 3 AS grp, avg(p_retailprice) OVER (PARTITION BY p_brand) AS estimate FROM part)"


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    mean = parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("estimate"))
    photo = F.concat_ws("-", "p_brand", (F.col("p_partkey") % 4).cast("string"))
    return parts.join(mean, "p_brand").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 10).alias("area"), photo.alias("photo"), F.floor(F.col("p_partkey") / 3).alias("grp"), "estimate")


@query(f"""WITH {_L}, s AS (SELECT photo, count(DISTINCT area) AS areas FROM l GROUP BY 1), g AS (SELECT grp, max(price) > min(price) * 1.001 AND count(*) > 1 AS odd FROM l GROUP BY 1)
SELECT id, 'bait_price' AS flag FROM l WHERE price < estimate * 0.9 * 0.95 UNION ALL SELECT id, 'photo_reuse' FROM l JOIN s USING (photo) WHERE areas >= 3 UNION ALL SELECT id, 'inconsistent_relist' FROM l JOIN g USING (grp) WHERE odd""")
def an25_listing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three flags; neighbours in a group of three stand for the duplicates that a model decides on."""
    rows = _listings(spark, sf_dir)
    first = rows.groupBy("grp").agg(F.min("id").alias("a"))
    duplicates = rows.join(first, "grp").where("id <> a").select("a", F.col("id").alias("b"))
    estimates = rows.select("id", "estimate", (F.col("estimate") * 0.9).alias("low"))
    return listings.flags(duplicates, rows, estimates, rows.select("id", "photo"), 0.05, 1.001, 3).select("id", "flag")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS pattern, o_orderstatus, o_totalprice, row_number() OVER () AS r FROM orders), f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48)
SELECT pattern, count(*) AS planted, count(l_orderkey) AS found, count(l_orderkey) / count(*) AS recall, round(CAST(sum(CASE WHEN l_orderkey IS NULL THEN CAST(o_totalprice AS DECIMAL(18, 2)) END) AS DOUBLE) / sum(CASE WHEN l_orderkey IS NULL THEN 1 END), 4) AS missed_gap FROM o LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1""")
def an27_pattern_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pattern"), "o_totalprice")
    flagged = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    out = ev.pattern_recall(planted, flagged, ["o_orderkey"], "pattern", F.col("o_totalprice").cast("decimal(18,2)"))
    return out.withColumn("missed_gap", F.round(F.col("missed_gap").cast("double"), 4))


@query("""SELECT c_mktsegment AS control, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS flagged, count(*) FILTER (c_acctbal < 0) / count(*) AS rate FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""")
def an27_control_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("control")
    return ev.control_rates(table(spark, sf_dir, "customer").select(control, "c_acctbal"), "control", F.col("c_acctbal") < 0)


@query("""WITH x AS (SELECT p_size AS a, CASE WHEN p_partkey % 5 > 0 THEN p_size + p_partkey % 3 END AS b, p_brand AS c, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS d FROM part)
SELECT 'size' AS slot, count(*) AS n, count(*) FILTER (coalesce(abs(a - b) <= 0.1 * abs(b), a IS NULL AND b IS NULL)) AS "right", count(*) FILTER (coalesce(abs(a - b) <= 0.1 * abs(b), a IS NULL AND b IS NULL)) / count(*) AS accuracy FROM x
UNION ALL SELECT 'brand', count(*), count(*) FILTER (c IS NOT DISTINCT FROM d), count(*) FILTER (c IS NOT DISTINCT FROM d) / count(*) FROM x""")
def an47_slot_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("parsed_size"), F.when(key % 5 > 0, F.col("p_size") + key % 3).alias("true_size"), F.col("p_brand").alias("parsed_brand"), F.when(key % 7 > 0, F.col("p_brand")).alias("true_brand"))
    return ev.slot_accuracy(rows, {"size": 0.1, "brand": None})


_C = """c AS (SELECT doc_id, source, n_chars, 2 * quality + (1 - toxic) AS grade, toxic FROM documents JOIN labels USING (doc_id)), s AS (SELECT 'longest' AS contender, source, doc_id, n_chars AS score, grade, toxic FROM c UNION ALL SELECT 'newest', source, doc_id, doc_id, grade, toxic FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY contender, source ORDER BY score DESC, doc_id) AS rank FROM s), i AS (SELECT *, row_number() OVER (PARTITION BY contender, source ORDER BY grade DESC, rank) AS ideal FROM r),
q AS (SELECT contender, source, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) END) AS best, min(CASE WHEN grade >= 3 THEN rank END) AS first, sum(CASE WHEN rank <= 5 AND grade >= 3 THEN 1 ELSE 0 END) AS hits, avg(CASE WHEN rank <= 10 THEN toxic END) AS toxic FROM i GROUP BY 1, 2)"""


@query(f"""WITH {_C} SELECT contender, count(*) AS queries, round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0 END), 6) AS ndcg, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(hits / 5), 6) AS "precision", round(avg(toxic), 6) AS toxic FROM q GROUP BY 1""")
def an48_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("grade", 2 * F.col("quality") + (1 - F.col("toxic")))
    scored = docs.select(F.lit("longest").alias("contender"), "source", "doc_id", F.col("n_chars").cast("double").alias("score"), "grade", "toxic").unionByName(docs.select(F.lit("newest").alias("contender"), "source", "doc_id", F.col("doc_id").cast("double").alias("score"), "grade", "toxic"))
    out = ev.contenders(scored, "contender", "source", "doc_id", F.col("score"), "grade", 10, 3, {"toxic": F.col("toxic")})
    return out.select("contender", "queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "precision", "toxic")])


@query("""WITH c AS (SELECT p_partkey, unnest([{'name': 'brand', 'value': CAST(p_partkey % 11 - 5 AS DOUBLE)}, {'name': 'price', 'value': CAST(p_partkey % 7 - 3 AS DOUBLE)}, {'name': 'size', 'value': CAST(p_size % 9 - 4 AS DOUBLE)}, {'name': 'year', 'value': CAST(p_size % 5 - 2 AS DOUBLE)}]) AS d FROM part),
r AS (SELECT p_partkey, d.name AS name, d.value AS value, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(d.value) DESC, d.name) AS r FROM c WHERE abs(d.value) >= 2)
SELECT p_partkey, coalesce(string_agg(name || '=' || CAST(CAST(value AS INTEGER) AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3), '') AS drivers FROM (SELECT p_partkey FROM part) LEFT JOIN r USING (p_partkey) GROUP BY 1""")
def so5_top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", *[c.cast("double").alias(n) for n, c in {"brand": key % 11 - 5, "price": key % 7 - 3, "size": size % 9 - 4, "year": size % 5 - 2}.items()])
    drivers = ev.top_drivers(["brand", "price", "size", "year"], 3, 2.0)
    return rows.select("p_partkey", F.array_join(F.transform(drivers, lambda d: F.concat_ws("=", d["name"], d["value"].cast("int").cast("string"))), ",").alias("drivers"))


@query("""SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS l_partkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS l_quantity FROM lineitem GROUP BY 1""")
def ag12_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ev.ordered_lists(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], ["l_partkey", "l_quantity"])


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey)) AS INTEGER) AS position FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey)) <= 20""")
def prj16_fn19_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of exactly n rows of each segment, in a seeded order; the limit is the operator's feature."""
    from terrane.operators.retrieval import Window

    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(sc.seeded_order(F.col("c_custkey"), 7)))
    return table(spark, sf_dir, "customer").select("c_custkey", place.alias("position")).where("position <= 20")


@query("""WITH n AS (SELECT p_partkey, 'The ' || p_brand || CASE p_size % 4 WHEN 0 THEN ' Phase 2' WHEN 1 THEN ' IV - West' WHEN 2 THEN ' 10' ELSE '' END AS name, 'The ' || p_brand AS b, p_size % 4 AS k FROM part),
v AS (SELECT p_partkey, unnest(CASE k WHEN 0 THEN [b || ' Phase 2', b || ' Phase II', b] WHEN 1 THEN [b || ' IV', b || ' 4', b] WHEN 2 THEN [b || ' 10', b || ' X', b] ELSE [b] END) AS x FROM n), w AS (SELECT p_partkey, x FROM v UNION SELECT p_partkey, substr(x, 5) FROM v)
SELECT p_partkey, string_agg(x, '|' ORDER BY x) AS names FROM w GROUP BY 1""")
def fn21_number_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    name = F.concat(F.lit("The "), F.col("p_brand"), F.when(k == 0, " Phase 2").when(k == 1, " IV - West").when(k == 2, " 10").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sc.number_variants(name), "|").alias("names"))


@query("""SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings""")
def fn17_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to text and back."""
    v = sc.parse_vector(sc.vector_literal(F.transform("embedding", lambda x: x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), v[0].alias("first"))


@query("""WITH l AS (SELECT event_type AS name, CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status, ts AS t FROM events), s AS (SELECT name, run_id, t, row_number() OVER (PARTITION BY name ORDER BY t DESC, run_id DESC) AS r FROM l WHERE status = 'succeeded')
SELECT name, run_id, CAST(epoch_us(t) AS BIGINT) AS started FROM s WHERE r = 1""")
def cat2_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest success of each name, from a ledger of runs that the events stand for."""
    status = F.when(F.col("event_id") % 3 == 0, "failed").otherwise("succeeded")
    ledger = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("run_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return sinks.latest_runs(ledger).select("name", "run_id", F.unix_micros("at").alias("started"))


@query()
def an45_an27_generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings made from parts with planted clones: how many of each pattern a shared photo set with equal size, area
    and text finds, and what is wrong with the corpus."""
    part = table(spark, sf_dir, "part")
    homes = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("area"), F.when(F.col("p_size") < 25, "flat").otherwise("villa").alias("kind"), (F.col("p_size") % 6).alias("bedrooms"), (F.col("p_size") * 10).alias("size"), (F.col("p_retailprice") * 1000).alias("price"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 200).cast("int")).alias("posted"))
    listings = cut(generator.corpus(homes), "corpus")
    problems = generator.corpus_problems(listings).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("problems"))
    same = ["photo", "size", "area", "text"]
    twins = listings.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    flagged = listings.join(twins, same, "left_semi").select("id")
    recall = ev.pattern_recall(listings.where("pattern is not null"), flagged, ["id"], "pattern", F.col("price"))
    return recall.select("pattern", "planted", "found", "recall").join(F.broadcast(problems))
