"""Queries on scalar functions, segments, splits, set operations and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scalars as sc
from terrane.operators import ingestion, ranks
from terrane.operators.bags import hashed_bags
from terrane.plans.catalogue import query
from terrane.session import table
from terrane.sources import readers
from terrane.sources.scans import Declared, between, case_of, scan


@query("""SELECT doc_id, nullif(array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' '), lambda t: t <> 'al' AND t <> ''), ' '), '') AS match_key FROM documents""")
def fn6_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sc.match_key(F.col("text")).alias("match_key"))


@query("""SELECT p_partkey, try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS DOUBLE) AS number, TRY_CAST(p_type AS DOUBLE) AS bad, CASE WHEN p_size > 0 THEN round(p_retailprice / p_size, 6) END AS per_size,
round(ln(p_retailprice), 8) AS log, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS whole, upper(p_brand) || '|' || p_type AS key FROM part""")
def fn2_fn3_fn7_fn8_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = sc.parse_float(F.regexp_extract("p_brand", "([0-9]+)$", 1))
    per = F.when(F.col("p_size") > 0, F.round(F.col("p_retailprice") / F.col("p_size"), 6))
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), sc.parse_float(F.col("p_type")).alias("bad"), per.alias("per_size"), F.round(F.ln("p_retailprice"), 8).alias("log"), sc.parse_int(F.col("p_retailprice").cast("string")).alias("whole"), sc.composite_key(F.upper("p_brand"), F.col("p_type")).alias("key"))


@query("""SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y')::DATE AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, CAST(o_orderdate AS DATE) - 92 AS before,
CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS split FROM orders""")
def fn1_fn10_prj10_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    split = F.when(d < "1998-01-01", "train").when(d < "2000-01-01", "validation").otherwise("test")
    m = F.year(d) * 12 + F.month(d) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.parse_date(F.date_format(d, "dd-MM-yyyy")).alias("day"), F.trunc(d, "month").alias("month"), m.alias("m"), F.date_sub(F.to_date(d), 92).alias("before"), split.alias("split"))


@query("""SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS words, len(string_split(p_name, ' ')) AS n, list_contains(string_split(p_type, ' '), 'TIN') AS tin, greatest(p_size, 25) AS most, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM part""")
def fn9_fn11_fn12_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(words)).alias("words"), F.size(words).cast("long").alias("n"), F.array_contains(F.split("p_type", " "), "TIN").alias("tin"), F.greatest("p_size", F.lit(25)).alias("most"), F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("none")).alias("brand"))


@query("""SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, CAST(props->>'missing' AS INTEGER) AS missing, '{"type":"' || event_type || '","user":' || user_id || '}' AS packed FROM events""")
def fn13_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int, missing int")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), props["missing"].alias("missing"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("packed"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents), s AS (SELECT doc_id, CAST(('0x' || substr(sha256(word), 1, 8))::BIGINT % 384 AS INTEGER) AS slot, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, slot, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM s""")
def fn15_hashed_bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = hashed_bags(table(spark, sf_dir, "documents"), "doc_id", "text")
    return bags.select("doc_id", "slot", "n", F.round(F.col("n") / F.col("length"), 6).alias("weight"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'small' WHEN p_size <= 25 THEN 'middle' ELSE 'large' END || '_' || split_part(p_type, ' ', 1) || '_' || CASE WHEN p_retailprice BETWEEN 900 AND 1200 THEN 'low' WHEN p_retailprice BETWEEN 1200 AND 2100 THEN 'high' ELSE 'out' END AS segment FROM part""")
def prj7_prj8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") <= 5, "small").when(F.col("p_size") <= 25, "middle").otherwise("large")
    band = F.when(F.col("p_retailprice").between(900, 1200), "low").when(F.col("p_retailprice").between(1200, 2100), "high").otherwise("out")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", size, F.split("p_type", " ")[0], band).alias("segment"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(upper(p_name) || '-' || p_brand, '\\p{L}+|\\P{L}+'), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS name, p_brand AS short,
CASE p_size % 4 WHEN 0 THEN 'Studio' WHEN 1 THEN CAST(p_size % 9 + 1 AS VARCHAR) || ' B/R' WHEN 2 THEN 'Single Room' ELSE p_brand END AS label, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size % 9 + 1 END AS bedrooms FROM part""")
def fn4_fn5_names_and_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = F.when(F.col("p_size") % 4 == 0, " studio ").when(F.col("p_size") % 4 == 1, F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("  b/r"))).when(F.col("p_size") % 4 == 2, "SINGLE   room").otherwise(F.col("p_brand"))
    shouted = F.concat(F.lit("  "), F.upper("p_name"), F.lit("-"), F.upper("p_brand"), F.lit(" "))
    found = sc.parse_rooms(rooms)
    return table(spark, sf_dir, "part").select("p_partkey", sc.display_name(shouted).alias("name"), sc.display_name(F.col("p_brand")).alias("short"), found["label"].alias("label"), found["bedrooms"].alias("bedrooms"))


@query("""WITH s AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'villa' WHEN 1 THEN 'unit' ELSE 'land' END AS t, CASE p_size % 4 WHEN 0 THEN 'Flat' WHEN 1 THEN 'Hotel Apartment' WHEN 2 THEN 'Tower' END AS st, CASE WHEN p_partkey % 7 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'ready' ELSE 'off_plan' END END AS reg,
CASE p_size % 6 WHEN 0 THEN 'Studio' WHEN 1 THEN '2 B/R' WHEN 2 THEN 'Penthouse' WHEN 3 THEN 'Single Room' WHEN 4 THEN 'Shop' END AS r FROM part), b AS (SELECT *, CASE WHEN t = 'villa' AND st IS NULL THEN 'plot' ELSE 'built_up' END AS basis FROM s)
SELECT p_partkey, basis AS size_basis, CASE WHEN t = 'villa' THEN 'villa' WHEN st = 'Flat' THEN 'flat' WHEN st = 'Hotel Apartment' THEN 'hotel_apartment' END AS sub_kind, CASE r WHEN 'Studio' THEN 'studio' WHEN '2 B/R' THEN 'bedrooms' WHEN 'Penthouse' THEN 'penthouse' WHEN 'Single Room' THEN 'single_room' ELSE 'unknown' END AS room_kind,
CASE r WHEN 'Studio' THEN 0.0::DOUBLE WHEN '2 B/R' THEN 2.0::DOUBLE END AS bedrooms, t || '_' || reg || '_' || basis AS segment FROM b""")
def prj7_sale_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "villa").when(size % 3 == 1, "unit").otherwise("land")
    sub = F.when(size % 4 == 0, "Flat").when(size % 4 == 1, "Hotel Apartment").when(size % 4 == 2, "Tower")
    registration = F.when(F.col("p_partkey") % 7 > 0, F.when(F.col("p_partkey") % 2 == 0, "ready").otherwise("off_plan"))
    rooms = F.when(size % 6 == 0, "Studio").when(size % 6 == 1, "2 B/R").when(size % 6 == 2, "Penthouse").when(size % 6 == 3, "Single Room").when(size % 6 == 4, "Shop")
    sales = table(spark, sf_dir, "part").select("p_partkey", kind.alias("property_type"), sub.alias("property_sub_type"), registration.alias("reg_type"), rooms.alias("rooms"))
    return ingestion.segments(sales).select("p_partkey", "size_basis", "sub_kind", "room_kind", "bedrooms", "segment")


@query("""WITH c AS (SELECT p_size % 20 AS area_id, p_brand AS name, p_type AS project FROM part), n AS (SELECT area_id, name, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, name) AS r FROM c GROUP BY 1, 2), a AS (SELECT area_id, name, replace(lower(name), '#', ' ') AS key FROM n WHERE r = 1),
p AS (SELECT project, area_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY project) AS total, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, area_id) AS r FROM c GROUP BY 1, 2),
u AS (SELECT key, name AS alias, area_id, 'official' AS source, 0 AS o FROM a UNION ALL SELECT lower(project), project, area_id, 'master_project', 1 FROM p WHERE r = 1 AND total >= 8 AND n / total >= 0.2 UNION ALL SELECT 'first', 'First', area_id, 'curated', 2 FROM a WHERE key = 'brand 11' UNION ALL SELECT key, 'Brand 12', area_id, 'curated', 2 FROM a WHERE key = 'brand 12')
SELECT alias_key, alias, CAST(area_id AS INTEGER) AS area_id, source FROM (SELECT key AS alias_key, alias, area_id, source, row_number() OVER (PARTITION BY key, area_id ORDER BY o, alias) AS r FROM u) WHERE r = 1""")
def an2_area_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and aliases by the pipeline's own functions; areas may share a key, and all of them stay."""
    sales = table(spark, sf_dir, "part").select((F.col("p_size") % 20).alias("area_id"), F.col("p_brand").alias("area_name"), F.lit(None).cast("string").alias("area_name_ar"), F.col("p_type").alias("master_project"), F.lit(None).cast("string").alias("exclusion_reason"))
    curated = spark.createDataFrame([("First", "Brand#11"), ("Brand 12", "brand 12"), ("Nowhere", "nowhere")], "alias string, area_name_en string")
    return ingestion.aliases(ingestion.areas(sales), sales, curated, 8, 0.2)[0]


@query("""WITH s AS (SELECT p_brand FROM part WHERE p_size BETWEEN 1 AND 40 GROUP BY 1 HAVING count(*) >= 60) SELECT p_brand, count(*) AS kept FROM part WHERE p_size BETWEEN 1 AND 40 AND p_brand IN (SELECT p_brand FROM s) GROUP BY 1""")
def prj9_supported_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where(F.col("p_size").between(1, 40))
    supported = parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n >= 60").select("p_brand")
    return parts.join(supported, "p_brand", "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT column_name AS "column", value, n FROM (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 2)""")
def src3_unexpected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.unexpected_values(table(spark, sf_dir, "orders"), {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM")})


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'distinct', count(DISTINCT c_mktsegment) FROM customer""")
def se1_se4_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return named(c.union(s).distinct(), "union").union(named(c.union(s), "all")).union(named(c.intersect(s), "both")).union(named(segments, "distinct"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS position FROM orders""")
def so1_prj11_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("position"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY CUBE (r_name, c_mktsegment, n_name) HAVING n_name IS NULL OR r_name IS NOT NULL""")
def jn1_jn3_dimension_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    out = rows.cube("r_name", "c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("total"))
    return out.where("n_name is null or r_name is not null").select("r_name", "n_name", "c_mktsegment", "n", "total")


_ORDERS = Declared("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz", ("o_custkey", "o_totalprice"))


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS position FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 100000 AND 300000 AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey IS NOT NULL""")
def src5_declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed scan by membership, ranges and known values, in order."""
    where = F.col("o_orderstatus").isin("F", "O") & between("o_totalprice", 100_000.0, 300_000.0) & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    rows = scan(spark, f"{sf_dir}/orders.parquet", _ORDERS, where)
    placed = ranks.ranked(rows, [F.col("o_orderdate"), F.col("o_orderkey")])
    return placed.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"), F.col("rank").cast("long").alias("position"))


@query("""SELECT CASE WHEN p_type LIKE '%STANDARD%' AND p_size < 20 THEN 'flat' WHEN p_type LIKE '%STANDARD%' THEN 'villa' WHEN p_size >= 40 THEN 'townhouse' ELSE 'other' END AS kind, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1""")
def src7_derived_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with a kind that a CASE derives."""
    rows = scan(spark, f"{sf_dir}/part.parquet", Declared("p_type string, p_size int, p_retailprice double"))
    standard = F.col("p_type").contains("STANDARD")
    kind = case_of([(standard & (F.col("p_size") < 20), "flat"), (standard, "villa"), (F.col("p_size") >= 40, "townhouse")], "other")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS squared FROM embeddings WHERE label IN (1, 2, 3) AND embedding IS NOT NULL""")
def src6_vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = scan(spark, f"{sf_dir}/embeddings.parquet", Declared(f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, label {kinds['label']}", ("embedding",)), F.col("label").isin(1, 2, 3))
    return held.select("vec_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squared"))
