"""Queries on candidate pairs, pair features and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import pairs as pr
from terrane.operators.graph import connected_components
from terrane.operators.neighbours import neighbours
from terrane.plans.catalogue import query
from terrane.session import table


@query("""WITH q AS (SELECT a.vec_id AS query, b.vec_id AS item, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 12) AS s
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)
SELECT query, item, CAST(rank AS INTEGER) AS rank, round(s, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS rank FROM q) WHERE rank <= 20""")
def jn10_an30_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    out = pr.nearest(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 20)
    return out.select("query", "item", "rank", F.round("cosine", 6).alias("cosine"))


@query("""WITH h AS (SELECT DISTINCT l_partkey AS item, l_orderkey AS k FROM lineitem), s AS (SELECT k FROM h GROUP BY k HAVING count(*) BETWEEN 2 AND 6)
SELECT DISTINCT x.item AS a, y.item AS b FROM h x JOIN h y USING (k) JOIN s USING (k) WHERE x.item < y.item""")
def jn11_shared_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.shared_key_pairs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 6, "order").select("a", "b")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    by_order = pr.shared_key_pairs(lines, "l_partkey", "l_orderkey", 3, "order")
    lines = lines.withColumn("stop", F.concat_ws("|", "l_suppkey", "day"))
    by_stop = pr.shared_key_pairs(lines, "l_partkey", "stop", 3, "stop")
    return pr.merged_channels(by_order, by_stop)


_CH = """ho AS (SELECT DISTINCT l_partkey AS item, l_orderkey AS k FROM lineitem), hs AS (SELECT DISTINCT l_partkey AS item, l_suppkey || '|' || CAST(l_shipdate AS DATE) AS k FROM lineitem),
so AS (SELECT k FROM ho GROUP BY k HAVING count(*) BETWEEN 2 AND 3), ss AS (SELECT k FROM hs GROUP BY k HAVING count(*) BETWEEN 2 AND 3),
u AS (SELECT x.item AS a, y.item AS b, 'order' AS channel FROM ho x JOIN ho y USING (k) JOIN so USING (k) WHERE x.item < y.item UNION SELECT x.item, y.item, 'stop' FROM hs x JOIN hs y USING (k) JOIN ss USING (k) WHERE x.item < y.item),
p AS (SELECT a, b, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources FROM u GROUP BY a, b)"""


@query(f"WITH {_CH} SELECT a, b, sources FROM p")
def an18_ag11_candidate_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir)


@query(f"""WITH {_CH} SELECT a, b, sources, round(abs(ln(x.p_retailprice / y.p_retailprice)), 6) AS price_gap, coalesce(x.p_brand = y.p_brand, false) AS same_brand, coalesce(x.p_type = y.p_type, false) AS same_type, abs(x.p_size - y.p_size) AS size_apart
FROM p JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b""")
def an19_jn6_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.both_ends(_channels(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice", "p_brand", "p_type", "p_size"])
    price, brand, kind = pr.relative_features(["p_retailprice"], ["p_brand", "p_type"])
    return rows.select("a", "b", "sources", F.round(price, 6).alias("price_gap"), brand.alias("same_brand"), kind.alias("same_type"), F.abs(F.col("p_size_a") - F.col("p_size_b")).alias("size_apart"))


@query(f"""WITH {_CH}, f AS (SELECT a, b, greatest(x.p_size, y.p_size) AS later FROM p JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b), c AS (SELECT quantile_disc(later, 0.6) AS c1, quantile_disc(later, 0.8) AS c2 FROM f)
SELECT CASE WHEN later <= c1 THEN 'train' WHEN later <= c2 THEN 'validation' ELSE 'report' END AS split, count(*) AS n FROM f, c GROUP BY 1""")
def an20_ordered_pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.both_ends(_channels(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey", ["p_size"]).select(F.greatest("p_size_a", "p_size_b").alias("later"))
    cuts = rows.agg(F.expr("percentile_disc(0.6) within group (order by later)").alias("c1"), F.expr("percentile_disc(0.8) within group (order by later)").alias("c2"))
    split = F.when(F.col("later") <= F.col("c1"), "train").when(F.col("later") <= F.col("c2"), "validation").otherwise("report")
    return rows.join(F.broadcast(cuts)).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE h AS (SELECT DISTINCT l_partkey AS item, l_suppkey || '|' || CAST(l_shipdate AS DATE) AS k FROM lineitem), s AS (SELECT k FROM h GROUP BY k HAVING count(*) BETWEEN 2 AND 4),
e AS (SELECT DISTINCT x.item AS a, y.item AS b FROM h x JOIN h y USING (k) JOIN s USING (k) WHERE x.item <> y.item), r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def an24_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat_ws("|", "l_suppkey", F.to_date("l_shipdate")).alias("stop"))
    return connected_components(pr.shared_key_pairs(lines, "l_partkey", "stop", 4, "stop"), "a", "b")


@query("""SELECT l_orderkey, count(*) AS n, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND max(l_extendedprice / l_quantity) > 100 * min(l_extendedprice / l_quantity)""")
def an25_inconsistent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ppu"))
    return pr.spread(rows, "l_orderkey", "ppu", 100.0)


@query("""WITH d AS (SELECT doc_id, md5(text) AS h, n_chars FROM documents), g AS (SELECT h, min(doc_id) AS first FROM d GROUP BY h)
SELECT doc_id, first, doc_id <> first AS is_copy FROM d JOIN g USING (h)""")
def jn13_copy_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").select("doc_id", "first", (F.col("doc_id") != F.col("first")).alias("is_copy"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def jn7_jn8_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    solvent = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(returned, "o_orderkey", "left_anti").join(solvent, "o_custkey", "left_semi").select("o_orderkey")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_max(v), 6) AS largest FROM e""")
def fn14_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(pr.norm(v), 6).alias("length"), F.round(pr.unit(v)[0], 6).alias("first"), F.round(F.array_max(F.transform(v, lambda x: x.cast("double"))), 6).alias("largest"))


@query("""WITH e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT label, i AS i, round(avg(x), 6) AS mean FROM e GROUP BY 1, 2""")
def fn14_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query()
def an18_corpus_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the ten nearest vectors of every vector, by an inverted file."""
    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
