"""Spans of pattern matches as native column expressions: places in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Kind:
    """A pattern whose leftmost non-overlapping matches count if `holds`; `value` is the part that matters.

    Quantifiers in patterns are possessive and matches begin only where a run begins, so a match takes time in
    proportion to its length and no stack, on texts of any length.
    """

    name: str
    pattern: str
    holds: Callable[[Column], Column] | None = None
    value: Callable[[Column], Column] | None = None


def found(text: Column, kind: Kind, rank: int) -> Column:
    """The matches of one kind as an array of (start, rank, end, kind, value)."""
    pattern = F.lit(kind.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.lit(None).cast(SPAN)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        value = kind.value(pair["hit"]) if kind.value else pair["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), value.alias("value"))
        holds = F.coalesce(kind.holds(pair["hit"]), F.lit(False)) if kind.holds else F.lit(True)
        return F.struct(end.alias("at"), F.when(holds, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    pairs = F.zip_with(hits, F.slice(between, 1, F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    placed = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, placed).otherwise(F.coalesce(empty, F.array().cast(SPAN)))


def base_spans(text: Column, kinds: tuple[Kind, ...]) -> Column:
    """All matches of all kinds, by start and then by the order of the kinds."""
    return F.array_sort(F.concat(*[found(text, kind, rank) for rank, kind in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
