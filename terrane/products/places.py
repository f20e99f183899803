"""The lexicon of places that a query may name, from the tables of areas, their aliases, buildings and projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import match_key, number_variants

#: Kinds by rank: where names have one key, the lowest rank has it. Variants of community names yield to given names.
KINDS = ("area", "variant", "building", "project")
#: Letters that a building's or project's name of one word has at least.
LEAST_LETTERS = 6


def guarded(key: Column) -> Column:
    """Whether a name reads like an ordinary word: one word, a leading `the` aside, without a digit."""
    bare = F.regexp_replace(key, "^the ", "")
    return ~bare.contains(" ") & ~bare.rlike("[0-9]")


def lexicon(areas: DataFrame, aliases: DataFrame | None = None, buildings: DataFrame | None = None, projects: DataFrame | None = None, communities: DataFrame | None = None) -> DataFrame:
    """(key, kind, name, area_ids, guarded), one row for each key; each table has name and area_id. Areas, aliases and
    communities give areas, with the ids of all rows of a key; communities also give spellings of their names, if no area
    has the key; buildings come before projects. The shown name is the first of its key, areas' own before others'.
    Names without a key, and short single words of buildings and projects, are left out."""

    def rows(table: DataFrame | None, rank: int, own: int, name: Column | str = "name") -> list[DataFrame]:
        if table is None:
            return []
        named = table.select(F.col("area_id").cast("long").alias("area_id"), (F.col(name) if isinstance(name, str) else name).alias("name"))
        return [named.select(F.lit(rank).alias("rank"), F.lit(own).alias("own"), "name", match_key(F.col("name")).alias("key"), "area_id").where("key is not null")]

    parts = rows(areas, 0, 0) + rows(aliases, 0, 1) + rows(communities, 0, 2)
    parts += rows(communities, 1, 0, F.explode(number_variants(F.col("name"))) if communities is not None else "name")
    named = [p.where(F.col("key").contains(" ") | (F.char_length("key") >= LEAST_LETTERS)) for p in rows(buildings, 2, 0) + rows(projects, 3, 0)]
    every = reduce(DataFrame.unionByName, parts + named)
    by_rank = every.groupBy("key", "rank").agg(F.min(F.struct("own", "name"))["name"].alias("name"), F.array_sort(F.collect_set("area_id")).alias("area_ids"))
    best = by_rank.groupBy("key").agg(F.min(F.struct("rank", "name", "area_ids")).alias("p"))
    kind = F.element_at(F.array(*[F.lit("area" if k == "variant" else k) for k in KINDS]), F.col("p.rank") + 1)
    return best.select("key", kind.alias("kind"), F.col("p.name").alias("name"), F.col("p.area_ids").alias("area_ids"), ((F.col("p.rank") > 0) & guarded(F.col("key"))).alias("guarded"))
