"""Batch scores of a whole table with a cache: a row is scored again only if it or the model has changed.

A row's digest covers the columns that the scorer reads and the model's version. Rows whose digest is that of the last
run keep their scores; new and changed rows are scored; rows that are gone are left out. The result is written beside
the last run and then takes its place, so a failed run changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import cut


def row_digest(columns: list[str], version: str) -> Column:
    """Equal for rows that are equal in these columns, nulls included, under one version of the model."""
    return F.sha2(F.concat_ws("\x01", F.lit(version), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def rescored(table: DataFrame, last: DataFrame | None, key: str, columns: list[str], version: str, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """((key, score, digest), counts): `score` gets the rows to score, with all their columns, and returns them with a
    `score`, null where a row can't be scored. Counts: total, scored, kept, unscorable. Keys are distinct."""
    rows = table.withColumn("__digest", row_digest(columns, version))
    if last is None:
        kept = rows.select(key, F.lit(None).cast("double").alias("score"), "__digest").limit(0)
        todo = rows
    else:
        known = last.select(F.col(key).alias("__k"), F.col("digest").alias("__d"), F.col("score").cast("double").alias("score"))
        same = (F.col(key) == F.col("__k")) & (F.col("__digest") == F.col("__d"))
        kept = rows.select(key, "__digest").join(known, same).select(key, "score", "__digest")
        todo = rows.join(known, same, "left_anti")
    todo = cut(todo, "to-score")
    fresh = score(todo.drop("__digest")).select(F.col(key).alias("__k"), F.col("score").cast("double").alias("score"))
    fresh = todo.select(key, "__digest").join(fresh, F.col(key) == F.col("__k"), "left").select(key, "score", "__digest")
    out = cut(kept.withColumn("__fresh", F.lit(False)).unionByName(fresh.withColumn("__fresh", F.lit(True))), "scores")
    n = out.agg(F.count(F.lit(1)).alias("total"), F.count_if("__fresh").alias("scored"), F.count_if(F.col("score").isNull()).alias("unscorable")).first()
    counts = {"total": n.total, "scored": n.scored, "kept": n.total - n.scored, "unscorable": n.unscorable}
    return out.select(key, "score", F.col("__digest").alias("digest")), counts
