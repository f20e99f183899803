"""Free-text queries to slots by a grammar over classes of words.

A text is cut into tokens, and each token is given the letter of its class: numbers, factors, currencies, units, words
that compare, open or join ranges, words for rooms, and so on. The letters of a text, one for each token, are a string
of their own, and a slot is a pattern over these letters; its values are read off the tokens at the same places. What a
slot has used gets the letter TAKEN, so later slots do not read it or across it. Order: size, budget (a range, at most,
at least, else a bare amount), places of the lexicon, bedrooms, types and amenities, places that are named but not
known, and the words left.

All but the dictionary look-up (see operators.phrases) is native; a table of any number of queries is parsed in one
scan, without a shuffle but the one that deals many queries to tasks of TASK_QUERIES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.phrases import with_phrases
from terrane.session import in_tasks

#: Queries that a task parses, about.
TASK_QUERIES = 20_000
#: Factors, square metres of a square foot, the smallest bare amount of money.
FACTORS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6}
SQM_PER_SQFT, LEAST_BARE = 0.092903, 10_000.0
#: Numbers in words, types of homes and what is not listed, amenities by what they are called.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7}
TYPES = {
    "hotel_apartment": ["hotel apartment", "hotel apartments", "serviced apartment", "serviced apartments"],
    "townhouse": ["town house", "town houses", "townhouse", "townhouses", "townhome", "townhomes"],
    "villa": ["villa", "villas"],
    "flat": ["apartment", "apartments", "flat", "flats"],
}
UNLISTED = {"plot": ["plot", "plots"], "land": ["land"]}
AMENITIES = {
    "covered parking": ["covered parking", "parking"],
    "shared pool": ["shared pool", "swimming pool", "pool"],
    "fully fitted kitchen": ["fully fitted kitchen", "fitted kitchen"],
    "built-in wardrobes": ["built-in wardrobes", "wardrobes"],
    "balcony": ["balcony"],
    "gym access": ["gym access", "gym"],
    "24/7 security": ["24/7 security", "security"],
    "children's play area": ["children's play area", "kids play area", "play area"],
    "maid's room": ["maid's room", "maids room", "maid room"],
    "sea view": ["sea view"],
    "community view": ["community view"],
    "central air conditioning": ["central air conditioning", "central ac"],
}
#: Words that no free text holds, and words that are near something rather than a place.
STOPWORDS = [
    "a", "an", "the", "i", "we", "me", "my", "for", "in", "at", "near", "around", "with", "and", "or", "vs", "looking", "want", "need", "to", "buy", "rent", "show", "find", "searching", "search",
    "please", "property", "properties", "home", "homes", "budget", "of", "al", "under", "below", "max", "up", "over", "above", "from", "between", "less", "more", "than", "least", "most", "min",
]
NEARBY = ["metro", "beach", "school", "schools", "mall", "airport", "park"]

#: Classes of words by letter. Numbers are N, words of no class w, stop words without one s, anything else `.`.
CLASSES = {
    "F": list(FACTORS),
    "C": ["aed"],
    "U": ["sqm", "m2", "m²", "sqft"],
    "Q": ["sq", "square"],
    "T": ["ft", "feet", "foot", "meter", "meters", "metre", "metres"],
    "J": ["to", "and", "-", "–", "—"],
    "O": ["between"],
    "f": ["from"],
    "L": ["under", "below", "max", "maximum", "within"],
    "G": ["over", "above", "min", "minimum"],
    "p": ["up"],
    "c": ["less"],
    "d": ["more"],
    "h": ["than"],
    "n": ["no"],
    "t": ["at"],
    "x": ["most"],
    "y": ["least"],
    "b": ["budget"],
    "o": ["of"],
    "g": ["starting"],
    "B": ["br", "bhk", "bed", "beds", "bedroom", "bedrooms"],
    "D": ["studio", "studios"],
    "W": list(NUMBER_WORDS),
    "i": ["in", "near", "around"],
    "e": ["the"],
    "k": NEARBY,
    "+": ["+"],
    ":": [":"],
    "s": ["al"],
}
TAKEN = "_"
TOKEN = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|[a-z][a-z0-9'²]*|[^\sa-z0-9]"
#: Slots over classes. An amount is a number with what marks it as money; groups are what opens a slot, and its amounts.
AMOUNT = "C?NF?C?"
AT_LEAST = "f|G|ty|dh|g[tf]"
SIZE = rf"((?:{AT_LEAST})?)(N)\+?(U|Q\.?(?:T|F))"
RANGE = f"([Of]?)({AMOUNT})(J)({AMOUNT})"
MOST = f"((?:ndh|L|pJ|ch|tx|bo?):?)({AMOUNT})"
LEAST = f"((?:{AT_LEAST}):?)({AMOUNT})"
BARE = f"()({AMOUNT})"
ROOMS = r"()(D|N[J+]?B|WJ?B)"
PLACE = "([it]e?)(w{1,3})"


def classed(token: Column) -> Column:
    """The letter of a token's class."""
    letters = {word: letter for letter, words in CLASSES.items() for word in words}
    letters |= {word: "s" for word in STOPWORDS if word not in letters}
    known = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    other = F.when(token.rlike("^[0-9]"), "N").when(token.rlike("^[a-z]"), "w").otherwise(".")
    return F.coalesce(F.try_element_at(known, token), other)


def places(letters: Column, pattern: str) -> Column:
    """The matches of a pattern as (at, hit): the letters, and how many tokens come before them."""
    hits = F.regexp_extract_all(letters, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(letters, pattern, -1), 1, F.size(hits))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["end"] + F.char_length(pair["gap"])
        return F.struct((at + F.char_length(pair["hit"])).alias("end"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), pair["hit"].alias("hit")))).alias("out"))

    pairs = F.zip_with(hits, between, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def token_at(tokens: Column, at: Column, letters: Column, wanted: str) -> Column:
    """The first token of a class within letters that begin after `at` tokens; null if there is none."""
    within = F.instr(letters, wanted)
    return F.when(within > 0, F.try_element_at(tokens, at + within))


def value(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def factor(tokens: Column, at: Column, letters: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, token_at(tokens, at, letters, "F")), F.lit(1.0))


def money(tokens: Column, at: Column, letters: Column) -> Column:
    """The amount of these letters: one with a factor or a currency, or a number large enough to be money."""
    amount = value(token_at(tokens, at, letters, "N")) * factor(tokens, at, letters)
    return F.when(letters.rlike("[FC]") | (amount >= LEAST_BARE), amount)


def part(hit: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(hit, pattern, group)


def first_money(tokens: Column, letters: Column, pattern: str) -> Column:
    """The first match of an opener and an amount that is money, as (at, hit, value)."""
    every = F.transform(places(letters, pattern), lambda m: F.struct(m["at"].alias("at"), m["hit"].alias("hit"), money(tokens, m["at"] + F.char_length(part(m["hit"], pattern, 1)), part(m["hit"], pattern, 2)).alias("value")))
    return F.try_element_at(F.filter(every, lambda m: m["value"].isNotNull()), F.lit(1))


def first_range(tokens: Column, letters: Column) -> Column:
    """The first range of two amounts as (at, hit, low, high). A first number that is no money by itself takes the factor
    of the second, or thousands if only that keeps it below the second."""

    def read(m: Column) -> Column:
        opener, one, join, two = (part(m["hit"], RANGE, i) for i in (1, 2, 3, 4))
        at = m["at"] + F.char_length(opener)
        after = at + F.char_length(one) + F.char_length(join)
        high, bare = money(tokens, after, two), value(token_at(tokens, at, one, "N"))
        scaled = bare * factor(tokens, after, two)
        taken = F.when((scaled > high) & (bare * 1e3 <= high), bare * 1e3).otherwise(F.when(two.rlike("[FC]") | (scaled >= LEAST_BARE), scaled))
        return F.struct(m["at"].alias("at"), m["hit"].alias("hit"), F.coalesce(money(tokens, at, one), taken).alias("low"), high.alias("high"))

    every = F.transform(places(letters, RANGE), read)
    return F.try_element_at(F.filter(every, lambda m: m["low"].isNotNull() & m["high"].isNotNull()), F.lit(1))


def taken(letters: Column, spans: Column) -> Column:
    """The letters with all tokens of the spans (at, length) taken."""

    def step(acc: Column, s: Column) -> Column:
        return F.concat(F.substring(acc, F.lit(1), s["at"]), F.rpad(F.lit(""), s["n"], F.lit(TAKEN)), F.substring(acc, s["at"] + s["n"] + 1, F.char_length(acc)))

    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<at:int,n:int>>")), letters, step)


def span(m: Column) -> Column:
    return F.when(m.isNotNull(), F.array(F.struct(m["at"].alias("at"), F.char_length(m["hit"]).alias("n"))))


def spans(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["at"].alias("at"), F.char_length(m["hit"]).alias("n")))


def phrase_key(text: str) -> str:
    """A fixed phrase as the words that dictionary look-ups compare: letters and digits, split at anything else."""
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def words_of(tokens: Column, letters: Column) -> Column:
    """(word, token) of all words of letters and digits of tokens that are not taken, `al` left out; a taken token is a word that
    no phrase has."""

    def one(token: Column, i: Column) -> Column:
        free = F.substring(letters, i + 1, F.lit(1)) != TAKEN
        split = F.filter(F.split(token, "[^a-z0-9]+"), lambda w: (w != "") & (w != "al"))
        return F.transform(F.when(free, split).otherwise(F.array(F.lit(TAKEN))), lambda w: F.struct(w.alias("word"), i.alias("token")))

    return F.flatten(F.transform(tokens, one))


def looked_up(rows: DataFrame, dictionary: DataFrame, phrase: str, info: list[str], name: str) -> DataFrame:
    """Adds `name`: the phrases found, as (at, n) in tokens with the dictionary's columns `info`."""
    words = rows.withColumn("__w", words_of(F.col("__tokens"), F.col("__letters")))
    words = words.withColumn("__words", F.transform("__w", lambda w: w["word"]))
    found, numbered = with_phrases(words, "__words", dictionary, phrase, "__found")
    table = F.broadcast(numbered.agg(F.map_from_entries(F.collect_list(F.struct("number", F.struct(*info)))).alias("__info")))  # one row

    def one(m: Column) -> Column:
        first, last = (F.element_at("__w", i)["token"] for i in (m["start"] + 1, m["end"]))
        return F.struct(first.alias("at"), (last - first + 1).alias("n"), *[F.col("__info")[m["phrase"]][c].alias(c) for c in info])

    out = found.join(table)
    return out.withColumn(name, F.transform("__found", one)).drop("__w", "__words", "__found", "__info")


def with_places(rows: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Adds the places of the lexicon that the text names. A guarded one counts after a preposition only."""
    if lexicon is None:
        return rows.withColumn("__known", F.array().cast("array<struct<at:int,n:int,kind:string,name:string,area_ids:array<bigint>,guarded:boolean>>"))
    found = looked_up(rows, lexicon, "key", ["kind", "name", "area_ids", "guarded"], "__known")
    before = lambda p: F.substring(F.col("__letters"), F.lit(1), p["at"])
    return found.withColumn("__known", F.filter("__known", lambda p: ~p["guarded"] | before(p).rlike("[it]e?$")))


def fixed_phrases(queries: DataFrame) -> DataFrame:
    """The fixed types and amenities as a dictionary."""
    rows = [(phrase_key(p), slot, name) for slot, table in (("type", TYPES), ("unlisted", UNLISTED), ("amenity", AMENITIES)) for name, own in table.items() for p in own]
    return queries.sparkSession.createDataFrame(rows, "phrase string, slot string, name string")


def parsed(queries: DataFrame, text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """Adds `slots`: bedrooms, kind, min_price, max_price, min_size, amenities, area_ids, area_name, building,
    building_area_ids, unlisted types, unknown places, errors and words; the lexicon (see products.places) is a dimension.
    Null and empty texts have empty slots. Write the result before filtering on slots: a filter that is pushed into the
    passes repeats them."""
    tokens, letters = F.col("__tokens"), F.col("__letters")
    low = F.replace(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("’"), F.lit("'"))
    rows = in_tasks(queries, TASK_QUERIES).withColumn("__tokens", F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn("__letters", F.array_join(F.transform("__tokens", classed), ""))

    def use(df: DataFrame, name: str, match: Column) -> DataFrame:
        return df.withColumn(name, match).withColumn("__letters", taken(letters, span(F.col(name))))

    sizes = F.transform(places(letters, SIZE), lambda m: F.struct(m["at"].alias("at"), m["hit"].alias("hit"), value(token_at(tokens, m["at"], m["hit"], "N")).alias("value"), F.exists(F.slice(tokens, m["at"] + 1, F.char_length(m["hit"])), lambda t: t.isin("sqft", "ft", "feet", "foot")).alias("feet")))
    rows = rows.withColumn("__sizes", sizes).withColumn("__letters", taken(letters, spans(F.col("__sizes"))))
    size = F.try_element_at("__sizes", F.lit(1))
    rows = use(rows, "__range", first_range(tokens, letters))
    rows = use(rows, "__most", F.when(F.col("__range").isNull(), first_money(tokens, letters, MOST)))
    rows = use(rows, "__least", F.when(F.col("__range").isNull(), first_money(tokens, letters, LEAST)))
    none = F.col("__range").isNull() & F.col("__most").isNull() & F.col("__least").isNull()
    rows = use(rows, "__bare", F.when(none, first_money(tokens, letters, BARE)))
    least, most = F.coalesce("__range.low", "__least.value"), F.coalesce("__range.high", "__most.value", "__bare.value")
    wrong = F.coalesce(least > most, F.lit(False))

    rows = with_places(rows, lexicon).withColumn("__letters", taken(letters, F.transform("__known", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n")))))
    counts = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    single = lambda m: (F.instr(m["hit"], "N") == 0) | (F.char_length(token_at(tokens, m["at"], m["hit"], "N")) == 1)
    rows = rows.withColumn("__rooms", F.filter(places(letters, ROOMS), single)).withColumn("__letters", taken(letters, spans(F.col("__rooms"))))
    room = F.try_element_at("__rooms", F.lit(1))
    beds = F.when(room["hit"] == "D", 0).otherwise(F.coalesce(token_at(tokens, room["at"], room["hit"], "N").try_cast("int"), F.try_element_at(counts, token_at(tokens, room["at"], room["hit"], "W"))))

    rows = looked_up(rows, fixed_phrases(queries), "phrase", ["slot", "name"], "__named")
    rows = rows.withColumn("__letters", taken(letters, F.transform("__named", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n")))))
    named = lambda slot: F.transform(F.filter("__named", lambda p: p["slot"] == slot), lambda p: p["name"])
    unknown = F.transform(places(letters, PLACE), lambda m: F.struct((m["at"] + F.char_length(part(m["hit"], PLACE, 1))).alias("at"), part(m["hit"], PLACE, 2).alias("hit")))
    rows = rows.withColumn("__unknown", unknown).withColumn("__letters", taken(letters, spans(F.col("__unknown"))))
    free = F.filter(F.transform(tokens, lambda t, i: F.when(F.substring(letters, i + 1, F.lit(1)) != TAKEN, F.trim(t, F.lit("'")))), lambda t: t.isNotNull() & (F.char_length(t) > 1) & t.rlike("^[a-z0-9]") & ~t.isin(*STOPWORDS) & ~t.rlike("^[0-9.,]+$"))
    area = F.try_element_at(F.filter("__known", lambda p: p["kind"] == "area"), F.lit(1))
    building = F.try_element_at(F.filter("__known", lambda p: p["kind"] != "area"), F.lit(1))
    no_ids = F.array().cast("array<bigint>")
    slots = F.struct(
        beds.alias("bedrooms"),
        F.try_element_at(named("type"), F.lit(1)).alias("kind"),
        F.when(~wrong, least).alias("min_price"),
        F.when(~wrong, most).alias("max_price"),
        F.round(size["value"] * F.when(size["feet"], SQM_PER_SQFT).otherwise(1.0), 2).alias("min_size"),
        F.array_distinct(named("amenity")).alias("amenities"),
        F.coalesce(area["area_ids"], no_ids).alias("area_ids"),
        area["name"].alias("area_name"),
        building["name"].alias("building"),
        F.coalesce(building["area_ids"], no_ids).alias("building_area_ids"),
        named("unlisted").alias("unlisted"),
        F.transform("__unknown", lambda m: F.array_join(F.slice(tokens, m["at"] + 1, F.char_length(m["hit"])), " ")).alias("unknown_places"),
        F.when(wrong, F.array(F.lit("budget_min_exceeds_max"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        free.alias("words"),
    )
    return rows.select(*queries.columns, slots.alias("slots"))
