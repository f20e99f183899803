"""The registered queries of the operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import filter_audit, hilbert_sharding, language_spans, odd_sketch, packing, pii_disclosure, projection_forest, secret_ownership, substring_dedup, suffix_arrays, token_alignment, toxic_crf, warc_derivatives
from terrane.llm.spans import counted, joined
from terrane.llm.toxic_crf import held_out
from terrane.session import table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.shard(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars", "doc_id"])


def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_arrays.judge(suffix_arrays.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


#: Words, all windows of a document of the lengths that windows of items have, and the items whose windows occur.
OP2_SQL = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
numbered AS (SELECT *, row_number() OVER () AS r, len(w) AS n FROM lowered),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS width FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, width, array_to_string(w[p : p + width - 1], ' ') AS g FROM (SELECT item, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM sized)),
placed AS (SELECT r, width, p, array_to_string(w[p : p + width - 1], ' ') AS g FROM (SELECT r, w, width, unnest(range(1, n - width + 2)) AS p FROM numbered, (SELECT DISTINCT width FROM sized) WHERE n >= width)),
found AS (SELECT r, p, width, item FROM placed JOIN wanted USING (width, g)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + width)) AS q FROM (SELECT DISTINCT r, p, width FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM numbered LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def op3_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxic_crf.score(docs, toxic_crf.fit(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", toxic_crf.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxic_crf.THRESHOLD).cast("int").alias("predicted"), spans.alias("spans"))


def _spans(found: DataFrame, kinds: tuple) -> DataFrame:
    every = F.array_sort(F.concat("base", "marks"))
    counts = [counted(F.col("base"), kind.name).alias(f"n_{kind.name}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(pii_disclosure.scan(table(spark, sf_dir, "documents")), pii_disclosure.KINDS)


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secret_ownership.scan(table(spark, sf_dir, "documents")), secret_ownership.KINDS)


def _hits(kinds: list[tuple[str, str, int, str]]) -> str:
    """Common table expressions: d (documents, numbered), and m (matches of each kind with value, start and end)."""
    found = " UNION ALL ".join(f"SELECT r, '{name}' AS kind, {rank} AS rank, {group} AS grp, regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {group}) AS vals, regexp_split_to_array(t, {pattern}) AS gaps FROM d" for rank, (name, pattern, group, _) in enumerate(kinds))
    holds = " ".join(f"WHEN '{name}' THEN {condition}" for name, _, _, condition in kinds)
    return f"""d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents), h AS ({found}),
u AS (SELECT r, kind, rank, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM h),
p AS (SELECT r, kind, rank, hits[i] AS hit, vals[i] AS value, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u),
m AS (SELECT *, start + length(hit) AS stop FROM p WHERE CASE kind {holds} END)"""


def _secrets_sql() -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", quoted(assign), 1, "length(value) >= 6"), ("access", quoted("AKIA[A-Z0-9]+"), 0, "length(hit) >= 20"), ("hex", quoted("[0-9a-f]+"), 0, "length(hit) >= 24")]
    w = secret_ownership
    return f"""WITH {_hits(kinds)},
o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) AS repositories FROM m JOIN d USING (r) GROUP BY value),
g AS (SELECT *, -list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) AS bits FROM o),
v AS (SELECT value, CASE WHEN owners >= {w.EXAMPLE_OWNERS} OR repositories >= {w.EXAMPLE_REPOSITORIES} THEN 'example' WHEN bits >= {w.LIVE_BITS} AND NOT regexp_matches(value, '{w.PLACEHOLDER}')
 AND CAST(regexp_matches(value, '[a-z]') AS INTEGER) + CAST(regexp_matches(value, '[A-Z]') AS INTEGER) + CAST(regexp_matches(value, '[0-9]') AS INTEGER) >= 2 THEN CASE WHEN owners = 1 THEN 'live' ELSE 'shared' END END AS verdict FROM g),
x AS (SELECT r, kind, rank, start, stop, value FROM m UNION ALL SELECT DISTINCT r, verdict, 3, stop - length(value), stop, value FROM m JOIN v USING (value) WHERE verdict IS NOT NULL),
j AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop, kind, value) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)"""


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Windows of 35 words as strings, those that start more than once, and the words that such windows cover.
OP6_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, p, array_to_string(w[p : p + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM split WHERE len(w) >= 35)),
again AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM windows JOIN again USING (g)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM split),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (r)
"""


def op8_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derive(warc_derivatives.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def _op9_sql() -> str:
    w = warc_derivatives
    quoted = lambda text: "'" + text.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"

    def resolved(text: str) -> str:
        for name, value in w.REFERENCES:
            text = f"replace({text}, {quoted(name)}, {quoted(value)})"
        return text

    pattern = lambda text: "'" + text.replace("'", "''") + "'"
    text = f"regexp_replace(regexp_replace(payload, {pattern(w.HIDDEN)}, ' ', 'g'), {pattern(w.BLOCK_TAGS)}, chr(10), 'g')"
    text = resolved(f"regexp_replace({text}, {pattern(w.OTHER_TAGS)}, '', 'g')")
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    title = f"trim(regexp_replace({resolved(f'regexp_extract(payload, {pattern(w.TITLE)}, 1)')}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"
    line = lambda name, value: f"CASE WHEN length({value}) > 0 THEN '{name}: ' || {value} || chr(13) || chr(10) ELSE '' END"
    urn = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
    language = f"regexp_extract(payload, {pattern(w.LANGUAGE)}, 1)"
    return f"""
WITH page AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
named AS (SELECT *, md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || payload) AS h FROM page),
response AS (SELECT *, {urn("h")} AS refers_to FROM named),
made AS (
  SELECT page_id, refers_to, url, payload, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
         {line("title", title)} || {line("language", language)}
         || coalesce(array_to_string(list_transform(regexp_extract_all(payload, {pattern(w.LINK)}, 1), lambda x: 'outlink: ' || x || chr(13) || chr(10)), ''), '') AS block FROM response
  UNION ALL
  SELECT page_id, refers_to, url, payload, 'conversion', 'text/plain; charset=utf-8', trim({text}, ' ' || chr(10)) FROM response)
SELECT page_id, warc_type, {urn("md5(warc_type || '|' || refers_to)")} AS record_id, refers_to, url AS target_uri, '{w.DATE}' AS warc_date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(payload) AS source_digest,
       'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) AS source_headers, block
FROM made"""


#: Shared shingles of every pair of rows, the links, and the smallest id that each row reaches by them.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS same FROM s x JOIN s y USING (g) WHERE x.r < y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(r, root) AS (SELECT r, r FROM d UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.r),
m AS (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN d o ON o.r = c.root GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""

#: The cosine of every pair of usable vectors of one length, in double precision.
OP5_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT r, v FROM d WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT x.r AS a, y.r AS b FROM u x JOIN u y ON len(x.v) = len(y.v) AND x.r <> y.r WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
n AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY 1),
c(r, root) AS (SELECT r, r FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.r),
m AS (SELECT c.r, min(o.vec_id) AS component_id FROM c JOIN d o ON o.r = c.root GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""


def op10_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op11_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_spans.predict(docs, language_spans.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_scores(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The failures of each document, all orders of the filters, and a fold over each order's letters.
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS lowest FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
 CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN doc_id > lowest THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders(o) AS (SELECT x FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
steps AS (SELECT o, k, o[k] AS x, o[1 : k - 1] AS earlier, o[1 : k] AS upto FROM (SELECT o, unnest(range(1, 6)) AS k FROM orders WHERE length(o) = 5)),
m AS (SELECT part, n, good, bad, fails, s.*, contains(fails, x) AS own, fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AS gone FROM c, steps s),
g AS (SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, x,
 sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM m GROUP BY part, o, k, x)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_sharding, op2_suffix_array_decontamination, op3_toxic_crf, op4_pii_disclosure, op5_projection_forest, op6_substring_dedup, op7_secret_ownership, op8_online_packing, op9_warc_derivatives, op10_odd_sketch_near_dedup, op11_language_spans, op12_token_alignment, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_decontamination": OP2_SQL, "op5_projection_forest": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_secret_ownership": _secrets_sql(), "op9_warc_derivatives": _op9_sql(), "op10_odd_sketch_near_dedup": OP10_SQL, "op13_filter_audit": OP13_SQL}
