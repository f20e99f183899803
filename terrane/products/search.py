"""Free-text search: slots, two retrieval channels, fusion, cluster collapse and a rule rank, for any number of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import retrieval
from terrane.products import matching
from terrane.products.queries import parsed
from terrane.session import cut

def search(listings: DataFrame, queries: DataFrame, k: int = 10, depth: int = 200, lexicon: DataFrame | None = None) -> DataFrame:
    """(query, id, rank, grade, score, notes): queries has query and text; listings id, text, bedrooms, price, kind, posted,
    cluster and, if they have them, size, area, building and project. Results are ranked by the rule grade (see
    products.matching), then by the fused score, and say of each stated slot how it is met; areas and buildings that a
    query names are those of the lexicon (see products.places)."""
    asked = cut(parsed(queries.select("query", "text"), lexicon=lexicon), "asked")  # written, so that no filter is pushed into the passes
    terms = asked.select("query", F.explode("slots.words").alias("term"))
    text = retrieval.ranked(retrieval.term_scores(listings, terms, "id", "text"), "query", F.round("score", 9), "doc", depth)
    known = [c for c in ("bedrooms", "price", "kind", "size", "area", "building", "project") if c in listings.columns]
    attributes = listings.select(F.col("id").alias("doc"), *known, F.col("text").alias("__text"), "posted", "cluster")
    stated = asked.select(F.col("query").alias("__q"), F.col("slots").alias("asked"))
    same = (F.col("asked.bedrooms") == F.col("bedrooms")) & (F.col("asked.kind").isNull() | (F.col("asked.kind") == F.col("kind")))
    slot_hits = attributes.select("doc", "bedrooms", "kind", "posted").join(stated, same).withColumnRenamed("__q", "query")
    slot_hits = retrieval.ranked(slot_hits.select("query", "doc", "posted"), "query", F.unix_date(F.to_date("posted")).cast("double"), "doc", depth)
    fused = retrieval.fused([text, slot_hits], "query", "doc").join(attributes, "doc").join(stated, F.col("query") == F.col("__q"))
    slots = matching.slots_of(F.col("asked"), {c: F.col(c) for c in known} | {"text": F.col("__text")})
    graded = fused.withColumns({"grade": matching.rule_grade(slots), "notes": matching.match_notes(slots)}).drop("asked", "__q", "__text")
    ranked = retrieval.ranked(graded, "query", F.col("grade") + F.round("score", 12), "doc")
    out = retrieval.collapsed(ranked, "query", "doc", F.coalesce("cluster", F.col("doc").cast("string")), "posted", k)
    return out.select("query", F.col("doc").alias("id"), "rank", "grade", "score", "notes")
