"""A corpus of listings from a table of homes, with planted clones and control groups, and queries with their true slots.

Every choice is a number of a stream that is named by the row's key, the purpose and the seed, so a row gets the same
whatever the partitioning, the order of rows or what else is in the table. All expressions are native; clones are rows
of the same scan, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.products.queries import NUMBER_WORDS

#: Shares of homes that are the source of a clone, by pattern, and of those in each control group.
PATTERNS = {"repost": 0.02, "repriced": 0.02, "reworded": 0.02}
CONTROLS = {"same_building": 0.05, "same_agent": 0.05}
#: Photo sets that listings share; clones show their source's.
PHOTO_SETS = 5000
AMENITIES = ("balcony", "shared pool", "sea view", "maid's room", "gym access")
OPENINGS = ("Bright", "Spacious", "Quiet", "Modern", "Charming")


def uniform(key: Column, purpose: str, seed: int) -> Column:
    """A number from 0 to 1 of the row's stream for a purpose."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(purpose), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def choice(key: Column, purpose: str, seed: int, values: tuple[str, ...]) -> Column:
    at = F.floor(uniform(key, purpose, seed) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def banded(u: Column, shares: dict[str, float]) -> Column:
    """The name whose share of the unit interval holds u; null beyond all of them."""
    chain, low = F.when(F.lit(False), F.lit(None).cast("string")), 0.0
    for name, share in shares.items():
        chain = chain.when((u >= low) & (u < low + share), F.lit(name))
        low += share
    return chain


def corpus(homes: DataFrame, seed: int = 17) -> DataFrame:
    """Listings: id, source (of a clone), pattern, control, area, kind, bedrooms, size, price, agent, photo, posted, text.
    homes: id, area, kind, bedrooms, size, price, posted; ids are distinct. A clone has its source's id with its
    pattern, is posted later, and differs by its pattern in price (`repriced`) or text (`reworded`)."""
    key = F.col("id").cast("string")
    pattern = banded(uniform(key, "pattern", seed), PATTERNS)
    control = F.when(pattern.isNull(), banded(uniform(key, "control", seed), CONTROLS))
    amenities = F.array_join(F.array_sort(F.array_distinct(F.array(choice(key, "amenity-1", seed, AMENITIES), choice(key, "amenity-2", seed, AMENITIES)))), " and ")
    told = lambda purpose: F.concat_ws(" ", choice(key, purpose, seed, OPENINGS), F.when(F.col("bedrooms") == 0, "studio").otherwise(F.concat(F.col("bedrooms").cast("string"), F.lit(" bedroom"))), F.replace("kind", F.lit("_"), F.lit(" ")), F.lit("with"), amenities)
    agent = lambda purpose: F.concat(F.lit("agent-"), F.floor(uniform(key, purpose, seed) * 400).cast("string"))
    photo = F.concat(F.lit("set-"), F.floor(uniform(key, "photo", seed) * PHOTO_SETS).cast("string"))
    base = homes.select(key.alias("id"), "area", "kind", "bedrooms", "size", F.col("price").cast("double").alias("price"), F.to_date("posted").alias("posted"), pattern.alias("pattern"), control.alias("control"), agent("agent").alias("agent"), agent("clone-agent").alias("__agent"), photo.alias("photo"), told("text").alias("text"), told("clone-text").alias("__text"), uniform(key, "shift", seed).alias("__shift"), uniform(key, "later", seed).alias("__later"))
    own = F.struct("id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("pattern"), "control", "area", "kind", "bedrooms", "size", "price", "agent", "photo", "posted", "text")
    repriced, reworded = F.col("pattern") == "repriced", F.col("pattern") == "reworded"
    clone = F.struct(
        F.concat_ws(":", "id", "pattern").alias("id"),
        F.col("id").alias("source"),
        "pattern",
        F.lit(None).cast("string").alias("control"),
        "area",
        "kind",
        "bedrooms",
        "size",
        F.when(repriced, F.round(F.col("price") * (0.7 + 0.2 * F.col("__shift")), 2)).otherwise(F.col("price")).alias("price"),
        F.col("__agent").alias("agent"),
        "photo",
        F.date_add("posted", F.floor(F.col("__later") * 60).cast("int") + 1).alias("posted"),
        F.when(reworded, F.concat(F.col("__text"), F.lit(", call now"))).otherwise(F.col("text")).alias("text"),
    )
    rows = base.select(F.explode(F.when(F.col("pattern").isNotNull(), F.array(own, clone)).otherwise(F.array(own))).alias("r"))
    return rows.select("r.*")


def corpus_problems(listings: DataFrame) -> DataFrame:
    """(problem, n) of what may not be in a corpus; empty if it is sound."""
    source = listings.select(F.col("id").alias("__id"), F.col("price").alias("__price"), F.col("text").alias("__text"), F.col("photo").alias("__photo"), F.col("posted").alias("__posted"))
    rows = listings.join(source, F.col("source") == F.col("__id"), "left")
    clone = F.col("source").isNotNull()
    rules = {
        "a clone without its source": clone & F.col("__id").isNull(),
        "a clone not later than its source": clone & (F.col("posted") <= F.col("__posted")),
        "a clone with other photos": clone & (F.col("photo") != F.col("__photo")),
        "a repost with another price or text": (F.col("pattern") == "repost") & ((F.col("price") != F.col("__price")) | (F.col("text") != F.col("__text"))),
        "a price that is not shifted": (F.col("pattern") == "repriced") & ~F.coalesce(F.col("price") / F.col("__price") <= 0.91, F.lit(True)),
        "a text that is not reworded": (F.col("pattern") == "reworded") & (F.col("text") == F.col("__text")),
        "a control group in a clone": clone & F.col("control").isNotNull(),
    }
    found = rows.select(F.explode(F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())).alias("problem"))
    repeated = listings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("an id that repeats").alias("problem"))
    return found.unionByName(repeated).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


#: How a query may say what it wants: the kind in words, and forms of a budget.
SPOKEN = {"villa": "villas", "flat": "Apartment", "townhouse": "town house", "hotel_apartment": "serviced apartments"}


def stated_queries(wants: DataFrame) -> DataFrame:
    """Adds text and true_<slot> to wants: form (0 to 4), bedrooms, kind, thousands (of money, whole), feet (of size),
    area, building, amenity and word. The form is how budget and rooms are said."""
    form, beds, money = F.col("form"), F.col("bedrooms"), F.col("thousands")
    spoken = F.element_at(F.create_map(*[F.lit(x) for pair in SPOKEN.items() for x in pair]), F.col("kind"))
    named = F.element_at(F.array(*[F.lit(w) for w in NUMBER_WORDS]), F.greatest(beds, F.lit(1)))
    rooms = F.when(beds == 0, F.lit("studio")).when(form == 1, F.concat(named, F.lit("-bedroom"))).otherwise(F.concat(beds.cast("string"), F.lit("BR")))
    least = money % 900 + 100
    budget = (
        F.when(form == 0, F.format_string("under %dk", money))
        .when(form == 1, F.format_string("between %dk and %d.5m", money, money))
        .when(form == 2, F.format_string("at least AED %d,000", least))
        .when(form == 3, F.format_string("%d-%dk", money, money + 50))
        .otherwise(F.format_string("%d,000", least))
    )
    low = F.when(form.isin(1, 3), money * 1e3).when(form == 2, least * 1e3)
    high = F.when(form == 0, money * 1e3).when(form == 1, money * 1e6 + 5e5).when(form == 3, (money + 50) * 1e3).when(form == 4, least * 1e3)
    text = F.concat_ws(" ", "word", rooms, spoken, F.lit("in"), "area", F.lit("at"), "building", budget, F.lit("over"), F.format_string("%d sqft with a", F.col("feet")), "amenity")
    true = {"bedrooms": beds, "kind": F.col("kind"), "min_price": low, "max_price": high, "min_size": F.round(F.col("feet") * 0.092903, 2), "area": F.col("area"), "building": F.col("building"), "words": F.col("word")}
    return wants.select("*", text.alias("text"), *[c.alias(f"true_{name}") for name, c in true.items()])
