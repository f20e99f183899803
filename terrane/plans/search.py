"""Queries on full text, fusion, collapse and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import evaluation as ev
from terrane.operators import retrieval as rt
from terrane.operators.covers import cover_scores
from terrane.operators.phrases import with_phrases
from terrane.plans.catalogue import query
from terrane.products.generator import stated_queries
from terrane.products.matching import ranking_features, rule_grade, slots_of, true_grade
from terrane.products.places import lexicon
from terrane.products.queries import parsed
from terrane.session import table

#: Query texts, stated as their terms.
ASKED = {1: ("the", "tion", "with"), 2: ("de", "la", "que"), 3: ("der", "und", "nicht"), 4: ("license", "example"), 5: ("password",)}


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, terms in ASKED.items() for t in terms], "query int, term string")


_Q = "q(query, term) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, terms in ASKED.items() for t in terms) + ")"
_TEXT = f"""{_Q}, w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), c AS (SELECT term, doc, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), s AS (SELECT query, doc, sum(ln(1 + tf) * ln(1 + n / df)) AS score FROM c JOIN f USING (term) JOIN q USING (term), n GROUP BY 1, 2),
t AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s)"""


def _text_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rt.term_scores(table(spark, sf_dir, "documents"), _queries(spark), "doc_id", "text")
    return rt.ranked(scored, "query", F.round("score", 9), "doc")


@query(f"WITH {_TEXT} SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM t WHERE rank <= 50")
def an31_so4_full_text_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_channel(spark, sf_dir).where("rank <= 50").select("query", "doc", "rank", F.round("score", 5).alias("score"))


@query()
def an31_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by how close together the asked words stand, compared by stems."""
    return cover_scores(table(spark, sf_dir, "documents"), _queries(spark), "doc_id", "text").select("query", F.col("doc"), "stems", F.round("score", 6).alias("score"))


_FUSED = f"""{_TEXT}, l AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc) AS rank FROM (SELECT query, doc_id AS doc, n_chars FROM documents, (SELECT DISTINCT query FROM q) WHERE lang = 'en')),
b AS (SELECT query, doc, rank FROM t WHERE rank <= 200 UNION ALL SELECT query, doc, rank FROM l WHERE rank <= 200), z AS (SELECT query, doc, sum(1.0 / (60 + rank)) AS score FROM b GROUP BY 1, 2),
y AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, doc) AS rank FROM z)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"), "n_chars")
    asked = F.explode(F.array(*[F.lit(q) for q in ASKED])).alias("query")
    by_length = rt.ranked(docs.select("doc", "n_chars", asked), "query", F.col("n_chars").cast("double"), "doc", 200)
    fused = rt.fused([_text_channel(spark, sf_dir).where("rank <= 200"), by_length], "query", "doc")
    return rt.ranked(fused, "query", F.round("score", 12), "doc")


@query(f"WITH {_FUSED} SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 8) AS score FROM y WHERE rank <= 50")
def an32_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).where("rank <= 50").select("query", "doc", "rank", F.round("score", 8).alias("score"))


@query(f"""WITH {_FUSED}, u AS (SELECT y.*, source, n_chars, row_number() OVER (PARTITION BY query, source ORDER BY n_chars NULLS LAST, doc) AS r FROM y JOIN documents ON doc_id = doc), k AS (SELECT query, doc, source, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM u WHERE r = 1)
SELECT query, doc, source, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def an33_cluster_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fused(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "n_chars"), "doc")
    return rt.collapsed(rows, "query", "doc", F.col("source"), "n_chars", 10).select("query", "doc", "source", "rank")


_GRADED = """g AS (SELECT source AS query, doc_id, 2 * quality + (1 - toxic) AS grade, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, rank) AS ideal FROM g)"""


@query(f"""WITH {_GRADED}, s AS (SELECT query, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) END) AS best, min(CASE WHEN grade >= 3 THEN rank END) AS first, sum(CASE WHEN rank <= 5 AND grade >= 3 THEN 1 ELSE 0 END) AS hits, avg(CASE WHEN rank <= 10 THEN grade END) AS top FROM i GROUP BY query)
SELECT query, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr, round(hits / 5, 6) AS "precision", round(top, 6) AS top FROM s""")
def an36_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query"), "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rt.ranked(docs.withColumn("grade", 2 * F.col("quality") + (1 - F.col("toxic"))), "query", F.col("n_chars").cast("double"), "doc_id")
    out = rt.ranking_metrics(rows, "query", "grade", 10, good=3)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "precision", "top")])


@query("""WITH t AS (SELECT vec_id AS item, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT label, round(count(*) FILTER (r <= 10 AND item % 3 = 0) / nullif(count(*) FILTER (item % 3 = 0), 0), 6) AS recall FROM t GROUP BY label""")
def ag27_retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.ranked(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", -F.col("vec_id").cast("double"), "vec_id")
    wanted = F.col("vec_id") % 3 == 0
    return rows.groupBy("label").agg(F.round(F.try_divide(F.count_if((F.col("rank") <= 10) & wanted), F.count_if(wanted)), 6).alias("recall"))


@query("""SELECT p_partkey, CAST((CASE WHEN p_size <= 20 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice < 1500 THEN 1 ELSE 0 END) + (CASE WHEN p_brand LIKE 'Brand#2%' THEN 1 ELSE 0 END) AS INTEGER) AS met, CASE WHEN p_size <= 20 AND p_retailprice < 1500 AND p_brand LIKE 'Brand#2%' THEN 3 WHEN p_size <= 25 AND p_retailprice < 1700 THEN 2 ELSE 1 END AS grade FROM part""")
def an35_prj18_slot_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = [F.col("p_size") <= 20, F.col("p_retailprice") < 1500, F.col("p_brand").like("Brand#2%")]
    near = (F.col("p_size") <= 25) & (F.col("p_retailprice") < 1700)
    met = sum((c.cast("int") for c in exact[1:]), exact[0].cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", met.alias("met"), F.when(exact[0] & exact[1] & exact[2], 3).when(near, 2).otherwise(1).alias("grade"))


#: A dictionary of phrases and the places they stand for; some begin or end inside others.
PHRASES = {"the of": "place-1", "of the": "place-2", "and the of": "place-3", "de la": "place-4", "la de": "place-5", "in": "place-6", "the": "place-7", "la de la": "place-8"}


@query(f"""WITH RECURSIVE p(phrase, place) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in PHRASES.items())}), w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM w), (SELECT unnest([1, 2, 3]) AS n) WHERE s + n - 1 <= len(w)),
m AS (SELECT doc_id, s, max(n) AS n, max_by(phrase, n) AS phrase, max_by(place, n) AS place FROM g JOIN p USING (phrase) GROUP BY doc_id, s),
x AS (SELECT m.*, o.s AS nxt FROM m ASOF LEFT JOIN (SELECT doc_id, s FROM m) o ON m.doc_id = o.doc_id AND m.s + m.n <= o.s),
c AS (SELECT doc_id, min(s) AS s FROM m GROUP BY doc_id UNION ALL SELECT x.doc_id, x.nxt FROM c JOIN x USING (doc_id, s) WHERE x.nxt IS NOT NULL)
SELECT phrase AS name, place, count(*) AS n FROM c JOIN x USING (doc_id, s) GROUP BY 1, 2""")
def jn15_an29_lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", rt.tokens(F.col("text")).alias("words"))
    found, numbered = with_phrases(rows, "words", spark.createDataFrame(list(PHRASES.items()), "name string, place string"), "name")
    hits = found.select(F.explode("found.phrase").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(numbered), "number").select("name", "place", "n")


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as areas, regions as their aliases, part names as buildings, market segments and part types as projects."""
    t = lambda name: table(spark, sf_dir, name)
    areas = t("nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("name"))
    aliases = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("area_id"), F.concat(F.lit("Al "), "r_name").alias("name"))
    buildings = t("part").select((F.col("p_partkey") % 25).alias("area_id"), F.col("p_name").alias("name"))
    projects = t("customer").select(F.col("c_nationkey").alias("area_id"), F.col("c_mktsegment").alias("name")).unionByName(t("part").select((F.col("p_partkey") % 25).alias("area_id"), F.col("p_name").alias("name")))
    return lexicon(areas, aliases, buildings, projects)


_KEY = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g')), ' '), lambda t: t <> 'al' AND t <> ''), ' ')"


@query(f"""WITH r AS (SELECT 0 AS rank, 0 AS own, n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT 0, 1, 'Al ' || r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 2, 0, p_name, p_partkey % 25 FROM part UNION ALL SELECT 3, 0, c_mktsegment, c_nationkey FROM customer UNION ALL SELECT 3, 0, p_name, p_partkey % 25 FROM part),
k AS (SELECT *, {_KEY.format("name")} AS key FROM r), g AS (SELECT key, rank, arg_min(name, (own, name)) AS name, list_sort(list_distinct(list(CAST(id AS BIGINT)))) AS area_ids FROM k WHERE key <> '' AND (rank = 0 OR contains(key, ' ') OR length(key) >= 6) GROUP BY key, rank)
SELECT key, CASE min(rank) WHEN 0 THEN 'area' WHEN 2 THEN 'building' ELSE 'project' END AS kind, arg_min(name, rank) AS name, array_to_string(arg_min(area_ids, rank), ',') AS ids, min(rank) > 0 AND NOT contains(key, ' ') AND NOT regexp_matches(key, '[0-9]') AS guarded FROM g GROUP BY key""")
def an29_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon(spark, sf_dir).select("key", "kind", "name", F.array_join("area_ids", ",").alias("ids"), "guarded")


@query("""WITH n AS (SELECT count(*) AS n FROM part) SELECT unnest(['bedrooms', 'kind', 'min_price', 'max_price', 'min_size', 'area', 'building', 'amenity', 'words']) AS slot, n, n AS "right", CAST(1 AS DOUBLE) AS accuracy FROM n""")
def an47_an28_parsed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a query for each part, written from its columns, against these: all of them are right."""
    part = table(spark, sf_dir, "part").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("villa", "flat", "townhouse", "hotel_apartment")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    wants = part.select(
        (F.col("p_partkey") % 5).alias("form"), (F.col("p_size") % 7).cast("int").alias("bedrooms"), kind.alias("kind"), (F.round(F.col("p_retailprice")) + 100).cast("int").alias("thousands"), (F.col("p_size") * 10).alias("feet"),
        F.col("n_name").alias("area"), F.col("p_name").alias("building"), F.lit("pool").alias("amenity"), F.lit("quiet").alias("word"),
    )
    asked = stated_queries(wants).withColumn("true_amenity", F.lit("shared pool"))
    got = parsed(asked, lexicon=_lexicon(spark, sf_dir))
    s = lambda name: F.col(f"slots.{name}").alias(f"parsed_{name}")
    rows = got.select("*", *[s(c) for c in ("bedrooms", "kind", "min_price", "max_price", "min_size", "building")], F.col("slots.area_name").alias("parsed_area"), F.array_join("slots.amenities", ",").alias("parsed_amenity"), F.array_join("slots.words", ",").alias("parsed_words")).drop("slots")
    return ev.slot_accuracy(rows, {c: 0.001 if c.endswith(("price", "size")) else None for c in ("bedrooms", "kind", "min_price", "max_price", "min_size", "area", "building", "amenity", "words")})


#: Stated queries and the slots that they mean: bedrooms, kind, min and max price, min size, area ids, building, amenities.
STATED = {
    0: ("2 bed villa in NATION_2 under 1.2m with a pool", "2, 'villa', NULL, 1200000, NULL, [2], NULL, ['shared pool']"),
    1: ("flat between 950k and 1.5m over 200 sqm balcony and gym", "NULL, 'flat', 950000, 1500000, 200, [], NULL, ['balcony', 'gym access']"),
    2: ("studio at red widget min 900k", "0, NULL, 900000, NULL, NULL, [], 'red widget', []"),
    3: ("townhouse al africa 300 sqm", "NULL, 'townhouse', NULL, NULL, 300, [0, 5, 10, 15, 20], NULL, []"),
    4: ("3br", "3, NULL, NULL, NULL, NULL, [], NULL, []"),
}
_ASKED = "a(query, beds, kind, low, high, least, areas, building, amenities) AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, {slots})" for q, (_, slots) in STATED.items()) + "))"
#: Parts as listings, each a candidate of one query, with what channels and estimates would say of it.
_LISTED = """l AS (SELECT p_partkey AS id, p_partkey % 5 AS query, p_partkey % 25 AS l_area, ['villa', 'flat', 'townhouse'][p_partkey % 3 + 1] AS l_kind, p_name AS l_building, p_brand AS l_project, p_size % 5 AS l_beds, CASE WHEN p_partkey % 11 > 0 THEN p_retailprice * 1000 END AS price,
p_size * 10 AS size, p_name || ' with ' || ['balcony', 'Shared Pool', 'gym access and balcony'][p_partkey % 3 + 1] AS text, DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER) AS posted FROM part)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = parsed(spark.createDataFrame([(q, t) for q, (t, _) in STATED.items()], "query int, text string"), lexicon=_lexicon(spark, sf_dir)).select("query", F.col("slots").alias("asked"))
    n = F.col("p_partkey")
    of = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 3 + 1).cast("int"))
    part = table(spark, sf_dir, "part").select(
        n.alias("id"), (n % 5).cast("int").alias("query"), (n % 25).alias("area"), of("villa", "flat", "townhouse").alias("kind"), F.col("p_name").alias("building"), F.col("p_brand").alias("project"), (F.col("p_size") % 5).alias("bedrooms"),
        F.when(n % 11 > 0, F.col("p_retailprice") * 1000).alias("price"), (F.col("p_size") * 10).alias("size"), F.concat_ws(" with ", "p_name", of("balcony", "Shared Pool", "gym access and balcony")).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")).alias("posted"),
    )
    return part.join(F.broadcast(asked), "query")  # the stated queries


def _slot_columns() -> tuple[Column, dict[str, Column]]:
    return F.col("asked"), {c: F.col(c) for c in ("area", "kind", "building", "project", "bedrooms", "price", "size", "text", "posted")}


_HITS = "len(list_filter(amenities, lambda x: contains(lower(text), x)))"
_KEYED = "trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g'))"
_NAMED = f"(coalesce({_KEYED.format('l_building')} = building, false) OR coalesce({_KEYED.format('l_project')} = building, false))"


@query(f"""WITH {_ASKED}, {_LISTED}, c AS (SELECT * FROM l JOIN a USING (query)), n AS (SELECT 'nan'::DOUBLE AS nan)
SELECT id, coalesce(abs(l_beds - beds)::DOUBLE, nan) AS beds_diff, (beds IS NOT NULL)::INT::DOUBLE AS beds_stated, coalesce(round(price / high - 1, 9), nan) AS price_over_max, coalesce(round(1 - price / low, 9), nan) AS price_under_min,
(low IS NOT NULL OR high IS NOT NULL)::INT::DOUBLE AS budget_stated, coalesce(round(size / least, 9), nan) AS size_ratio, CASE WHEN len(areas) > 0 THEN contains(areas, l_area)::INT::DOUBLE ELSE nan END AS area_match, (len(areas) > 0)::INT::DOUBLE AS area_stated,
CASE WHEN kind IS NOT NULL THEN (kind = l_kind)::INT::DOUBLE ELSE nan END AS type_match, (kind IS NOT NULL)::INT::DOUBLE AS type_stated, CASE WHEN building IS NOT NULL THEN {_NAMED}::INT::DOUBLE ELSE nan END AS building_match,
{_HITS}::DOUBLE AS amenity_hits, len(amenities)::DOUBLE AS amenity_asked, CASE WHEN id % 4 > 0 THEN round((id % 100) / 100.0, 9)::DOUBLE ELSE nan END AS semantic_cos, CASE WHEN id % 6 > 0 THEN round((id % 7) / 7.0, 9)::DOUBLE ELSE 0.0 END AS fulltext_rank,
CASE WHEN id % 4 > 0 THEN (id % 200)::DOUBLE ELSE nan END AS semantic_pos, CASE WHEN id % 6 > 0 THEN (id % 150)::DOUBLE ELSE nan END AS fulltext_pos, round(1.0 / (60 + id % 50), 9)::DOUBLE AS rrf_score, coalesce(round(CASE WHEN id % 9 > 0 THEN price / (900000 + id % 1000 * 100) END, 9), nan) AS price_to_estimate,
CASE WHEN id % 9 > 0 THEN coalesce(price BETWEEN (900000 + id % 1000 * 100) * 0.9 AND (900000 + id % 1000 * 100) * 1.1, false)::INT::DOUBLE ELSE nan END AS within_interval, (id % 13 = 0)::INT::DOUBLE AS flag_bait_price, (id % 17 = 0)::INT::DOUBLE AS flag_photo_reuse, 0.0::DOUBLE AS flag_inconsistent_relist,
(id % 3 + 1)::DOUBLE AS cluster_size, (DATE '2025-01-01' - posted)::DOUBLE AS days_since_posted FROM c, n""")
def an34_ranking_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    asked, listing = _slot_columns()
    estimate = F.when(n % 9 > 0, 900_000 + n % 1000 * 100)
    signals = {
        "semantic": F.when(n % 4 > 0, n % 100 / 100.0), "semantic_rank": F.when(n % 4 > 0, n % 200), "text_score": F.when(n % 6 > 0, n % 7 / 7.0), "text_rank": F.when(n % 6 > 0, n % 150), "fused": 1.0 / (60 + n % 50), "estimate": estimate, "low": estimate * 0.9, "high": estimate * 1.1,
        "bait_price": n % 13 == 0, "photo_reuse": F.when(n % 17 == 0, True), "cluster_size": n % 3 + 1,
    }
    made = ranking_features(asked, listing, signals, F.lit("2025-01-01").cast("date"))
    return _candidates(spark, sf_dir).select("id", *[F.round(c, 9).alias(name) for name, c in made.items()])


_GRADES = f"""g AS (SELECT id, len(areas) = 0 OR contains(areas, l_area) AS area_ok, kind IS NULL OR kind = l_kind AS type_ok, building IS NULL OR {_NAMED} AS building_ok,
beds IS NULL OR coalesce(l_beds = beds, false) AS b0, beds IS NULL OR coalesce(abs(l_beds - beds) <= 1, false) AS b1,
(low IS NULL AND high IS NULL) OR coalesce((low IS NULL OR price >= low) AND (high IS NULL OR price <= high), false) AS p0, (low IS NULL AND high IS NULL) OR coalesce((low IS NULL OR price >= low * 0.9) AND (high IS NULL OR price <= high * 1.1), false) AS p1,
least IS NULL OR size >= least AS s0, least IS NULL OR size >= least * 0.9 AS s1, {_HITS} >= len(amenities) AS m0, {_HITS} >= len(amenities) - (CASE WHEN len(amenities) = 2 THEN 1 ELSE 0 END) AS m1 FROM l JOIN a USING (query)),
h AS (SELECT *, area_ok AND type_ok AND building_ok AND b1 AND p1 AND s1 AND m1 AS fits, (NOT b0 AND b1)::INT + (NOT p0 AND p1)::INT + (NOT s0 AND s1)::INT + (NOT m0 AND m1)::INT AS near FROM g)"""


@query(f"""WITH {_ASKED}, {_LISTED}, {_GRADES} SELECT id, CASE WHEN fits AND near = 0 THEN 3 WHEN fits AND near = 1 THEN 2 ELSE 1 END AS rule_grade,
CASE WHEN id % 10 = 0 THEN least(1, CASE WHEN fits AND near <= 1 THEN 3 WHEN area_ok AND type_ok THEN 1 ELSE 0 END) ELSE CASE WHEN fits AND near = 0 THEN 3 WHEN fits AND near = 1 THEN 2 WHEN area_ok AND type_ok THEN 1 ELSE 0 END END AS true_grade FROM h""")
def an35_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = slots_of(*_slot_columns())
    return _candidates(spark, sf_dir).select("id", rule_grade(slots).alias("rule_grade"), true_grade(slots, F.col("id") % 10 == 0).alias("true_grade"))
