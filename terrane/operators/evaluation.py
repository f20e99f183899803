"""Evaluation tables: recall by planted pattern, control rates, accuracy of parsed slots, contenders side by side, drivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import retrieval


def pattern_recall(planted: DataFrame, flagged: DataFrame, keys: list[str], pattern: str, gap: Column) -> DataFrame:
    """(pattern, planted, found, recall, gap): how many planted rows of each pattern are among the flagged ones, and the
    mean gap of those that are not. Either side may be shuffled; flagged keys are made distinct first."""
    hits = planted.join(flagged.select(*keys).distinct().withColumn("__hit", F.lit(1)), keys, "left")
    found = F.count("__hit")
    return hits.groupBy(pattern).agg(F.count(F.lit(1)).alias("planted"), found.alias("found"), (found / F.count(F.lit(1))).alias("recall"), F.avg(F.when(F.col("__hit").isNull(), gap)).alias("missed_gap"))


def control_rates(rows: DataFrame, control: str, flagged: Column) -> DataFrame:
    """(control, n, flagged, rate): false positives of each control group; rows that belong to none are left out."""
    hit = F.count_if(flagged)
    return rows.where(F.col(control).isNotNull()).groupBy(control).agg(F.count(F.lit(1)).alias("n"), hit.alias("flagged"), (hit / F.count(F.lit(1))).alias("rate"))


def slot_accuracy(rows: DataFrame, slots: dict[str, float | None]) -> DataFrame:
    """(slot, n, right, accuracy) of columns parsed_<slot> against true_<slot>: numbers within a relative tolerance, all
    else equal, and nothing where nothing was meant. All slots come from one pass."""
    checks = []
    for slot, tolerance in slots.items():
        a, b = F.col(f"parsed_{slot}"), F.col(f"true_{slot}")
        equal = a.eqNullSafe(b) if tolerance is None else F.coalesce(F.abs(a - b) <= tolerance * F.abs(b), a.isNull() & b.isNull())
        checks.append(F.struct(F.lit(slot).alias("slot"), equal.alias("right")))
    each = rows.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    right = F.count_if("right")
    return each.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), right.alias("right"), (right / F.count(F.lit(1))).alias("accuracy"))


def contenders(scored: DataFrame, contender: str, query: str, item: str, score: Column, grade: str, k: int, good: int, side: dict[str, Column]) -> DataFrame:
    """(contender, queries, ndcg, mrr, precision, and the mean of each side effect over the first k): contenders are rows
    of one table, ranked within each query, so any number of them shares its shuffles."""
    both = F.concat_ws("\x01", contender, query)
    rows = retrieval.ranked(scored.withColumn("__q", both), "__q", score, item)
    metrics = retrieval.ranking_metrics(rows, "__q", grade, k, good)
    effects = rows.where(F.col("rank") <= k).groupBy("__q").agg(*[F.avg(c.cast("double")).alias(name) for name, c in side.items()])
    named = metrics.join(effects, "__q", "left").withColumn(contender, F.substring_index("__q", "\x01", 1))
    return named.groupBy(contender).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in ("ndcg", "mrr", "precision", *side)])


def top_drivers(contributions: list[str], k: int, least: float) -> Column:
    """The k columns of the largest absolute contribution, largest first, ties by name, those below `least` left out."""
    return drivers(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in contributions]), k, least)


def drivers(contributions: Column, k: int, least: float) -> Column:
    """The same of an array of (name, value), as operators.contributions gives it."""
    every = F.transform(contributions, lambda d: F.struct((-F.abs(d["value"])).alias("size"), d["name"].alias("name"), d["value"].alias("value")))
    kept = F.filter(every, lambda d: -d["size"] >= least)
    return F.transform(F.slice(F.array_sort(kept), 1, k), lambda d: F.struct(d["name"].alias("name"), d["value"].alias("value")))


def ordered_lists(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(keys, lists): the values of each key in order, as aligned lists. A key's rows meet in one row, so keys must be
    such that this is wanted, as the results of one query."""
    held = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("order"), F.struct(*values).alias("values"))))
    return df.groupBy(*keys).agg(held.alias("__l")).select(*keys, *[F.col(f"__l.values.{v}").alias(v) for v in values])
