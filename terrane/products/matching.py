"""How well a listing answers the slots of a query: slot by slot, as a grade, as features for a ranker, and in words.

A slot says whether the query states it, whether the listing has it exactly, and whether it nearly does. Everything
else follows from the list of slots, so a grade and a note can't disagree about what matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.scalars import match_key

#: Share by which a price or size may miss what is asked and is still near.
MARGIN = 0.10
NAN = float("nan")


@dataclass(frozen=True)
class Slot:
    name: str
    stated: Column
    exact: Column
    near: Column
    hard: bool = False

    @property
    def holds(self) -> Column:
        return ~self.stated | yes(self.exact)

    @property
    def nearly(self) -> Column:
        return ~self.stated | yes(self.near)


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def amenity_hits(asked: Column, text: Column) -> Column:
    """How many of the asked amenities the text names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.coalesce(asked, F.array().cast("array<string>")), lambda a: F.contains(low, F.lower(a))))


def slots_of(asked: Column, listing: dict[str, Column], margin: float = MARGIN) -> list[Slot]:
    """The slots of `asked` (as products.queries gives them) for a listing's area, kind, building, project, bedrooms,
    price, size and text. Where a listing has no value, a stated slot does not hold, not even nearly."""
    get = lambda name: listing.get(name, F.lit(None))
    low, high = asked["min_price"], asked["max_price"]
    within = lambda share: (low.isNull() | (get("price") >= low * (1 - share))) & (high.isNull() | (get("price") <= high * (1 + share)))
    key = match_key(asked["building"])
    named = (match_key(get("building").cast("string")) == key) | yes(match_key(get("project").cast("string")) == key)
    area, kind = F.array_contains(asked["area_ids"], get("area").cast("long")), get("kind") == asked["kind"]
    beds = F.abs(get("bedrooms") - asked["bedrooms"])
    wanted, hits = F.size(asked["amenities"]), amenity_hits(asked["amenities"], get("text"))
    return [
        Slot("area", F.size(asked["area_ids"]) > 0, area, area, True),
        Slot("type", asked["kind"].isNotNull(), kind, kind, True),
        Slot("building", asked["building"].isNotNull(), named, named, True),
        Slot("bedrooms", asked["bedrooms"].isNotNull(), beds == 0, beds <= 1),
        Slot("budget", low.isNotNull() | high.isNotNull(), within(0.0), within(margin)),
        Slot("size", asked["min_size"].isNotNull(), get("size") >= asked["min_size"], get("size") >= asked["min_size"] * (1 - margin)),
        Slot("amenities", wanted > 0, hits >= wanted, hits >= wanted - (wanted == 2).cast("int")),
    ]


def misses(slots: list[Slot]) -> Column:
    """How many slots hold nearly only."""
    return reduce(lambda a, b: a + b, [(~s.holds & s.nearly).cast("int") for s in slots], F.lit(0))


def _best(slots: list[Slot]) -> tuple[Column, Column]:
    fits = every([s.holds for s in slots if s.hard]) & every([s.nearly for s in slots if not s.hard])
    near = misses([s for s in slots if not s.hard])
    return fits & (near == 0), fits & (near == 1)


def rule_grade(slots: list[Slot]) -> Column:
    """3 if every slot holds, 2 if one soft slot holds nearly only, else 1."""
    all_hold, one_near = _best(slots)
    return F.when(all_hold, 3).when(one_near, 2).otherwise(1)


def true_grade(slots: list[Slot], fraud: Column) -> Column:
    """The same of what was meant: 1 only if area and type hold, else 0; a fraudulent listing has 1 at most."""
    all_hold, one_near = _best(slots)
    ground = every([s.holds for s in slots if s.name in ("area", "type")])
    graded = F.when(all_hold, 3).when(one_near, 2).when(ground, 1).otherwise(0)
    return F.when(yes(fraud), F.least(graded, F.lit(1))).otherwise(graded)


def match_notes(slots: list[Slot]) -> Column:
    """In words, of each stated slot: whether the listing matches it, comes close, or differs."""
    lines = [F.when(s.stated, F.concat(F.lit(f"{s.name} "), F.when(s.holds, "matches").when(s.nearly, "comes close").otherwise("differs"))) for s in slots]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


#: Fixed names: the features of a candidate, in order. NaN where the query does not state a slot, or nothing is known.
FEATURES = (
    "beds_diff", "beds_stated", "price_over_max", "price_under_min", "budget_stated", "size_ratio", "area_match", "area_stated", "type_match", "type_stated", "building_match", "amenity_hits", "amenity_asked",
    "semantic_cos", "fulltext_rank", "semantic_pos", "fulltext_pos", "rrf_score", "price_to_estimate", "within_interval", "flag_bait_price", "flag_photo_reuse", "flag_inconsistent_relist", "cluster_size", "days_since_posted",
)


def ranking_features(asked: Column, listing: dict[str, Column], signals: dict[str, Column], reference: Column) -> dict[str, Column]:
    """FEATURES by name. signals: semantic, semantic_rank, text_score, text_rank, fused; estimate, low, high; bait_price,
    photo_reuse, inconsistent_relist; cluster_size. `reference` is the day that ages count to."""
    slots = {s.name: s for s in slots_of(asked, listing)}
    get = lambda name: signals.get(name, F.lit(None))
    price, flag = listing.get("price", F.lit(None)), lambda c: c.cast("double")
    matched = lambda s: F.when(s.stated, flag(yes(s.exact)))
    known = get("estimate").isNotNull()
    made = {
        "beds_diff": F.abs(listing.get("bedrooms", F.lit(None)) - asked["bedrooms"]),
        "beds_stated": slots["bedrooms"].stated,
        "price_over_max": price / asked["max_price"] - 1,
        "price_under_min": 1 - price / asked["min_price"],
        "budget_stated": slots["budget"].stated,
        "size_ratio": listing.get("size", F.lit(None)) / asked["min_size"],
        "area_match": matched(slots["area"]),
        "area_stated": slots["area"].stated,
        "type_match": matched(slots["type"]),
        "type_stated": slots["type"].stated,
        "building_match": matched(slots["building"]),
        "amenity_hits": amenity_hits(asked["amenities"], listing.get("text", F.lit(None))),
        "amenity_asked": F.size(asked["amenities"]),
        "semantic_cos": get("semantic"),
        "fulltext_rank": F.coalesce(get("text_score"), F.lit(0.0)),
        "semantic_pos": get("semantic_rank"),
        "fulltext_pos": get("text_rank"),
        "rrf_score": get("fused"),
        "price_to_estimate": price / get("estimate"),
        "within_interval": F.when(known, flag(yes((price >= get("low")) & (price <= get("high"))))),
        **{f"flag_{name}": F.coalesce(get(name).cast("double"), F.lit(0.0)) for name in ("bait_price", "photo_reuse", "inconsistent_relist")},
        "cluster_size": get("cluster_size"),
        "days_since_posted": F.datediff(reference, listing.get("posted", F.lit(None))),
    }
    return {name: F.coalesce(made[name].cast("double"), F.lit(NAN)) for name in FEATURES}
