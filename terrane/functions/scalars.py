"""Scalar functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """dd-MM-yyyy, null if invalid."""
    return F.try_to_date(F.trim(text), "dd-MM-yyyy")


def parse_float(text: Column) -> Column:
    """A finite double or null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_int(text: Column) -> Column:
    """A long if the number is integral, else null."""
    x = parse_float(text)
    return F.when((x == F.floor(x)) & (F.abs(x) < 9e18), x.cast("long"))


def match_key(text: Column) -> Column:
    """Lower case, other characters than letters and digits as spaces, without the token `al`; blank is null."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " ")), " "), lambda t: (t != "al") & (t != ""))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Single spaces, none at the ends, blank as null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def title_case(text: Column) -> Column:
    """Each run of letters with its first letter in upper case and the others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def display_name(text: Column) -> Column:
    """One-spaced, and in title case if it is an upper-case name of more than five characters."""
    clean = one_spaced(text)
    shouted = (clean == F.upper(clean)) & (F.char_length(clean) > 5) & clean.rlike(r"\p{L}")
    return F.when(shouted, title_case(clean)).otherwise(clean)


#: Fixed room labels, by their upper-case form.
ROOM_LABELS = {"STUDIO": "Studio", "PENTHOUSE": "Penthouse", "GYM": "Gym", "OFFICE": "Office", "SHOP": "Shop", "SINGLE ROOM": "Single Room", "STORE": "Store"}


def parse_rooms(text: Column) -> Column:
    """(label, bedrooms): `n B/R` with its count, a studio with 0, other labels, known ones in their fixed form, without."""
    clean = one_spaced(text)
    count = F.nullif(F.regexp_extract(clean, r"(?i)^([1-9]) B/R$", 1), F.lit(""))
    fixed = F.create_map(*[F.lit(x) for pair in ROOM_LABELS.items() for x in pair])
    label = F.coalesce(F.concat(count, F.lit(" B/R")), F.try_element_at(fixed, F.upper(clean)), clean)
    return F.struct(label.alias("label"), F.coalesce(count.cast("int"), F.when(label == "Studio", 0)).alias("bedrooms"))


def bag_slot(word: Column, slots: int = 384) -> Column:
    """The slot of a word in a hashed bag of words: the first four bytes of its SHA-256, modulo the slots."""
    return (F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("long") % slots).cast("int")


def composite_key(*parts: Column) -> Column:
    """Parts joined by a bar; null if one is null."""
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, F.concat_ws("|", *parts))


def finite_positive(x: Column) -> Column:
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def vector_literal(vector: Column) -> Column:
    """[x, y, ...] as text, as vector columns of SQL databases spell it."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    """The doubles of such a text; null if the text or one of its numbers is none."""
    inner = F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1)
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(text.rlike(r"^\s*\[.*\]\s*$") & F.forall(numbers, lambda x: x.isNotNull()), numbers)


#: Fixed numerals of community names.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def number_variants(name: Column) -> Column:
    """The spellings of a community's name, sorted: the part before " - ", with a trailing number in digits and in Roman
    numerals and without it or a `Phase` before it, each also without a leading "the"."""
    head = F.trim(F.split(name, " - ")[0])
    base = F.trim(F.regexp_extract(head, r"(?i)^(.*\S)\s+([0-9]{1,2}|[ivx]+)$", 1))
    tail = F.upper(F.regexp_extract(head, r"(?i)^(.*\S)\s+([0-9]{1,2}|[ivx]+)$", 2))
    numerals = F.array(*[F.lit(r) for r in ROMAN])
    value = F.coalesce(tail.try_cast("int"), F.nullif(F.array_position(numerals, tail).cast("int"), F.lit(0)))
    known = (base != "") & value.between(1, len(ROMAN))
    bare = F.regexp_replace(base, r"(?i)\s+phase$", "")
    names = F.when(known, F.array(head, F.concat_ws(" ", base, value.cast("string")), F.concat_ws(" ", base, F.try_element_at(numerals, value)), bare)).otherwise(F.array(head))
    short = F.transform(F.filter(names, lambda n: F.lower(n).startswith("the ")), lambda n: F.substring(n, 5, 1 << 30))
    return F.array_sort(F.array_distinct(F.filter(F.concat(names, short), lambda n: F.trim(n) != "")))


def seeded_order(key: Column, seed: int) -> Column:
    """An order of keys that looks random and depends on the seed alone: sort by it for a shuffle, take its first n for
    an exact sample."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
