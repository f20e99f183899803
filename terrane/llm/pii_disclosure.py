"""PII removal by information-theoretic sanitisation.

Fixed patterns find the protected entities. The corpus then tells which terms near an entity reveal it: with n(t, e)
documents that hold term t next to entity e, n(t) and n(e) that hold either, out of N, the share of the entity's
information that the term discloses is PMI(t, e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)). Terms that
stand next to an entity in at least `support` different contexts are removed from a share of `REMOVE` on. From a share
of `GENERALISE` on they are generalised to the class of all words with their first `CLASS` letters (`zanzibar` to
`zan*`), if the same measure, counted for the whole class, finds that the class discloses less than `GENERALISE`;
otherwise they are removed too. Only the estimate looks at the places near entities: a term found to disclose one is
marked at all its places in the texts of all documents, by its highest share.

All counts cover all documents and are pre-aggregated. The term counts join against the terms in question only, which
Spark broadcasts when that table is small and shuffles otherwise. Texts are scanned for entities once, and written.

DataFrame functions only. Defined results: a null text is empty and has no span. Repeated rows are judged alike; they
count as documents but not as further contexts. An empty table gives an empty result. Further columns are ignored by
the scan and kept by the sanitiser, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.spans import SPAN, Kind, base_spans, found
from terrane.session import cut


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda part: F.regexp_like(part, F.lit("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))


def is_card(match: Column) -> Column:
    d = digits(match)
    return F.when(F.char_length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False)


#: Fixed patterns of the base entities.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_ip),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11,}+", is_card),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.char_length(digits(m)).between(9, 15)),
)
#: Code points on either side of an entity that are its context, and what counts as a term there.
REACH, TERM = 80, Kind("term", r"(?<!\p{L})\p{L}{3,}+", value=F.lower)
SUPPORT, GENERALISE, REMOVE = 3, 0.75, 0.9
#: First letters of a term that name the class it is generalised to.
CLASS = 3


def with_sides(text: Column, spans: Column) -> Column:
    """The spans with the text on either side of each, and whether a word may be cut at the far end of it."""

    def one(s: Column) -> Column:
        low = F.greatest(s["start"] - REACH, F.lit(0))
        left = F.struct(F.substring(text, low + 1, s["start"] - low).alias("part"), (low > 0).alias("cut_left"), F.lit(False).alias("cut_right"))
        right = F.struct(F.substring(text, s["end"] + 1, F.lit(REACH)).alias("part"), F.lit(False).alias("cut_left"), (F.char_length(text) > s["end"] + REACH).alias("cut_right"))
        return F.struct(s.alias("span"), F.array(left, right).alias("sides"))

    return F.transform(spans, one)


def near_terms(rows: DataFrame) -> DataFrame:
    """(row, entity, context, term): the terms next to the entities of each row."""
    held = rows.select("row", F.explode("spans").alias("s"))
    entity = F.unhex(F.substring(F.sha2(F.concat_ws(":", "s.span.kind", F.lower("s.span.value")), 256), 1, 32))  # 128 bits name an entity
    context = F.xxhash64(F.col("s.sides")[0]["part"], F.col("s.sides")[1]["part"])
    sides = held.select("row", entity.alias("entity"), context.alias("context"), F.explode("s.sides").alias("side"))
    terms = sides.select("row", "entity", "context", "side", F.explode(found(F.col("side.part"), TERM, 0)).alias("t"))
    whole = ~(F.col("side.cut_left") & (F.col("t.start") == 0)) & ~(F.col("side.cut_right") & (F.col("t.end") >= F.char_length("side.part")))
    return terms.where(whole).select("row", "entity", "context", F.col("t.value").alias("term"))


def share(n: Column) -> Column:
    """The share of an entity's information, from n_both, n_term and n_entity."""
    both = F.least("n_both", "n_term", "n_entity").cast("double")
    return F.ln(n * both / (F.col("n_term") * F.col("n_entity"))) / F.ln(n / F.col("n_entity"))


def words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM.pattern), F.lit(0)), F.lower))


def disclosing(rows: DataFrame, near: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(row, terms) for the documents that hold terms which disclose too much of an entity, terms being a map from
    these to what is to be done; rows has row and text for each document."""
    n = F.lit(float(max(rows.count(), 1)))
    counts = F.count_distinct("row").alias("n_both"), F.count_distinct("context").alias("contexts")
    together = near.groupBy("entity", "term").agg(*counts).where(F.col("contexts") >= support)
    entities = cut(near.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "counted")
    # A term is held by at least the documents that have it next to some entity. Where these are too many already for
    # the lowest share, its other documents need not be counted.
    beside = near.select("term", "row").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_beside"))
    most = F.least("n_both", "n_entity") * F.pow(n / F.col("n_entity"), F.lit(1 - generalise)) * 1.000001
    together = cut(together.join(entities, "entity").join(beside, "term").where((F.col("n_entity") < n) & (F.col("n_beside") <= most)), "together")
    asked = cut(together.select("term").distinct(), "terms")
    held = cut(rows.select("row", F.explode(words(F.col("text"))).alias("term")).join(asked, "term"), "held")
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = together.join(terms, "term").groupBy("term").agg(F.max(share(n)).alias("share")).where(F.col("share") >= generalise)
    scored = cut(scored.withColumn("class", F.substring("term", 1, CLASS)), "scored")

    # What a class tells at most follows from its documents next to entities alone; only where that does not settle it
    # are its other documents counted.
    of_class = near.select(F.substring("term", 1, CLASS).alias("class"), "entity", "row").distinct()
    by_class = cut(of_class.groupBy("class", "entity").agg(F.count(F.lit(1)).alias("n_both")).join(entities, "entity"), "class-entities")
    beside = of_class.select("class", "row").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n_term"))
    asked = scored.where(F.col("share") < remove).select("class").distinct()
    at_most = cut(by_class.join(beside, "class").groupBy("class").agg(F.max(share(n)).alias("most")).join(asked, "class"), "class-bounds")
    first = lambda terms: F.array_distinct(F.transform(terms, lambda w: F.substring(w, 1, CLASS)))
    unsettled = at_most.where(F.col("most") >= generalise).select("class")
    in_class = rows.select(F.explode(first(words(F.col("text")))).alias("class")).join(unsettled, "class").groupBy("class").agg(F.count(F.lit(1)).alias("n_term"))
    tells = by_class.join(in_class, "class").groupBy("class").agg(F.max(share(n)).alias("class_share"))
    settled = F.coalesce(F.col("most") < generalise, F.lit(False)) | F.coalesce(F.col("class_share") < generalise, F.lit(False))
    action = F.when((F.col("share") < remove) & settled, "generalise").otherwise("remove").alias("action")
    flagged = scored.join(at_most, "class", "left").join(tells, "class", "left").select("term", action)
    return held.join(flagged, "term").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("terms"))


def marked(text: Column, terms: Column) -> Column:
    """The spans of all places of these terms in the text; none where terms are null."""
    spans = found(text, Kind(TERM.name, TERM.pattern, lambda m: F.map_contains_key(terms, F.lower(m)), F.lower), len(KINDS))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.element_at(terms, s["value"]).alias("kind"), s["value"].alias("value")))
    return F.when(terms.isNotNull(), named).otherwise(F.array().cast(SPAN))


def judged(docs: DataFrame, carried: Column, text_col: str, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(carried, text, base, marks) for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), carried.alias("carried"), text.alias("text"), base_spans(text, KINDS).alias("base")), "entities")
    near = cut(near_terms(rows.where(F.size("base") > 0).select("row", with_sides(F.col("text"), F.col("base")).alias("spans"))), "contexts")
    terms = cut(disclosing(rows.select("row", "text"), near, support, generalise, remove), "disclosing")
    out = rows.join(terms, "row", "left")
    return out.select("carried", "text", "base", marked(F.col("text"), F.col("terms")).alias("marks"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per document: id, base (spans of entities) and marks (spans `generalise` and `remove` of terms)."""
    return judged(docs, F.col(id_col), text_col, support, generalise, remove).select(F.col("carried").alias(id_col), "base", "marks")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities replaced by their kind in brackets, generalised terms by their class, and removed ones
    cut out; of overlapping spans the first is named, and what the others reach beyond it is cut out too."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        instead = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", F.concat(F.substring(s["value"], 1, CLASS), F.lit("*"))).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        rest = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], rest).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, instead)).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), zero, step, rest)).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The documents, with all their columns, and entities and disclosing terms out of the text; null texts stay."""
    clean = F.when(F.col("carried")[text_col].isNotNull(), sanitised(F.col("text"), F.concat("base", "marks")))
    found = judged(docs, F.struct("*"), text_col, support, generalise, remove)
    return found.select(*[(clean if c == text_col else F.col("carried")[c]).alias(c) for c in docs.columns])
