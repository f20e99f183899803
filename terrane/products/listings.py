"""Duplicate and misuse checks of listings, for a corpus or a few incoming rows through the same plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import learning, pairs
from terrane.operators.graph import connected_components
from terrane.operators.neighbours import neighbours

FEATURES = ["cosine", "price_gap", "size_gap", "same_area", "same_agent", "days_apart"]


def candidates(listings: DataFrame, photos: DataFrame, k: int, fan_out: int) -> DataFrame:
    """(a, b, sources): near vectors, by the index of operators.neighbours, and shared photos. listings: id, vector;
    photos: id, photo."""
    near = neighbours(listings, "id", "vector", k)
    near = near.select(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b"), F.lit("vector").alias("channel"))
    return pairs.merged_channels(near, pairs.shared_key_pairs(photos, "id", "photo", fan_out, "photo"))


def pair_features(found: DataFrame, listings: DataFrame) -> DataFrame:
    rows = pairs.both_ends(found, listings, "id", ["vector", "price", "size", "area", "agent", "posted"])
    price, size, area, agent, days = pairs.relative_features(["price", "size"], ["area", "agent"], "posted")
    cosine = F.try_divide(pairs.dot(F.col("vector_a"), F.col("vector_b")), pairs.norm(F.col("vector_a")) * pairs.norm(F.col("vector_b")))
    rest = [c for c in found.columns if c not in ("a", "b")]
    return rows.select("a", "b", *rest, cosine.alias("cosine"), price.alias("price_gap"), size.alias("size_gap"), area.cast("double").alias("same_area"), agent.cast("double").alias("same_agent"), days.cast("double").alias("days_apart"), F.greatest("posted_a", "posted_b").alias("later"))


@dataclass
class ListingChecker:
    model: PipelineModel
    threshold: float

    @classmethod
    def fit(cls, features: DataFrame, label: str, precision: float = 0.95) -> ListingChecker:
        """A pair model, and the lowest score from which on this precision is kept."""
        from terrane.operators.estimates import precision_recall

        model = learning.fit_pair_model(features, FEATURES, label)
        ranked = precision_recall(learning.pair_scores(model, features).withColumn("__key", F.concat_ws("-", "a", "b")), label, "score", "__key")
        found = ranked.where(F.col("precision") >= precision).agg(F.min("score")).first()[0]
        return cls(model, 1.0 if found is None else float(found))

    def duplicates(self, features: DataFrame, price_blind: bool = False) -> DataFrame:
        return learning.pair_scores(self.model, features, "price_gap" if price_blind else None).where(F.col("score") >= self.threshold)

    def check(self, incoming: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
        """Duplicates of a few incoming rows (id, vector, price, ...) among a corpus of the same columns."""
        near = pairs.nearest(incoming, corpus, "id", "vector", k).select(F.col("query").alias("a"), F.col("item").alias("b"))
        return self.duplicates(pair_features(near, corpus.unionByName(incoming)))


def flags(duplicates: DataFrame, listings: DataFrame, estimates: DataFrame, photos: DataFrame, margin: float = 0.2, relist_spread: float = 1.25, min_areas: int = 2) -> DataFrame:
    """(id, flag, detail as JSON): bait_price (asked below the estimated range by more than the margin), photo_reuse
    (a photo set of listings in several areas) and inconsistent_relist (groups of duplicates with spread prices).

    listings: id, price, area; estimates: id, estimate, low; photos: id, photo; duplicates: a, b.
    """
    bait = listings.select("id", "price").join(estimates.select("id", "estimate", "low"), "id").where(F.col("price") < F.col("low") * (1 - margin))
    below = F.round((1 - F.col("price") / F.col("low")) * 100, 1).alias("below_low_pct")
    bait = bait.select("id", F.lit("bait_price").alias("flag"), F.to_json(F.struct("price", "estimate", "low", below)).alias("detail"))
    shown = photos.select("id", "photo").distinct().join(listings.select("id", "area"), "id")
    reused = shown.groupBy("photo").agg(F.count_distinct("area").alias("areas"), F.count(F.lit(1)).alias("listings")).where(F.col("areas") >= min_areas)
    reuse = shown.join(reused, "photo").select("id", F.lit("photo_reuse").alias("flag"), F.to_json(F.struct("photo", "areas", "listings")).alias("detail"))
    members = connected_components(duplicates, "a", "b").join(listings.select(F.col("id").alias("node"), "price"), "node")
    odd = pairs.spread(members, "root", "price", relist_spread)
    relist = members.join(odd, "root").select(F.col("node").alias("id"), F.lit("inconsistent_relist").alias("flag"), F.to_json(F.struct("root", "n", "low", "high")).alias("detail"))
    return bait.unionByName(reuse).unionByName(relist)


def stored(flagged: DataFrame, asked: DataFrame) -> DataFrame:
    """The stored flags of the asked ids, one row for each id, with an empty list where there is none."""
    own = asked.select("id").distinct().join(flagged, "id", "left")
    held = F.collect_list(F.when(F.col("flag").isNotNull(), F.struct("flag", "detail")))
    return own.groupBy("id").agg(F.array_sort(held).alias("flags"))
