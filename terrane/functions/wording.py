"""Results in plain words, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(x: Column) -> Column:
    """A share as a percentage with its sign and one decimal."""
    return F.format_string("%+.1f%%", x * 100.0)


def driver_lines(drivers: Column, names: dict[str, str] | None = None) -> Column:
    """One line for each driver (name, value) of a growth in logs: `momentum 1y +2.0%`."""
    known = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    label = lambda d: F.coalesce(F.try_element_at(known, d["name"]), F.replace(d["name"], F.lit("_"), F.lit(" ")))
    return F.transform(drivers, lambda d: F.concat_ws(" ", label(d), percent(F.expm1(d["value"]))))


def exclusion_line(excluded: Column, total: Column, reason: Column) -> Column:
    """`12 of 300 left out (4.0%): reason`; null where nothing is left out."""
    return F.when(excluded > 0, F.format_string("%d of %d left out (%.1f%%): %s", excluded.cast("long"), total.cast("long"), 100.0 * excluded / total, reason))
