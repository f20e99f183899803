"""Candidate pairs by shared keys and vectors, pair features, and groups of linked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def shared_key_pairs(df: DataFrame, item: str, key: str, fan_out: int, channel: str) -> DataFrame:
    """(a, b, channel) for items that share a key held by at most fan_out items; the cap is the operator's feature."""
    held = df.select(item, key).distinct()
    small = held.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n").between(2, fan_out))
    use = held.join(small.select(key), key)
    pairs = use.alias("x").join(use.alias("y"), key).where(F.col(f"x.{item}") < F.col(f"y.{item}"))
    return pairs.select(F.col(f"x.{item}").alias("a"), F.col(f"y.{item}").alias("b"), F.lit(channel).alias("channel")).distinct()


#: Rows of the base that a task multiplies with a block of queries.
SLICE = 65_536


def nearest(queries: DataFrame, base: DataFrame, item: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query, item, cosine, rank): exact k nearest of each query among all base rows but itself, ties by item.

    The stated query set meets the base in blocks of vectors: a task multiplies one block of queries with a slice of
    the base and keeps k per query, so what is shuffled is k rows per query and slice, not all pairs.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.select(F.col(item).alias("item"), F.col(vector).alias("v"))
    count = asked.count()
    blocks = max(1, -(-count // block))
    left = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    slices = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, -(-base.count() // SLICE))
    right = base.select(F.col(item).alias("item"), F.col(vector).alias("v"), F.pmod(F.xxhash64("item"), F.lit(slices)).alias("slice"))
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(F.col("item").alias("query"), "v", "block", F.col("slice").cast("long").alias("slice"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("item", "v", F.col("block").cast("long").alias("block"), "slice")

    def matrix(table: pa.Table) -> np.ndarray:
        v = table.column("v").combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        asked_ids, ids = a.column("query").to_numpy(), b.column("item").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        sims = matrix(a) @ matrix(b)[order].T
        sims[asked_ids[:, None] == ids[None, :]] = -np.inf
        least = np.partition(sims, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
        # Ties of the k-th may be more than k rows; the rank decides, on cosines that are rounded below what sums differ by.
        rows, columns = np.nonzero((sims >= least[:, None] - 1e-11) & np.isfinite(sims))
        return pa.table({"query": asked_ids[rows], "item": ids[columns], "cosine": sims[rows, columns]})

    near = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(best, "query long, item long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "item"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def merged_channels(*channels: DataFrame) -> DataFrame:
    """(a, b, sources): pairs of all channels with the names of those that found them."""
    rows = channels[0]
    for other in channels[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))


def both_ends(pairs: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The pairs with a dimension's columns for either end, as <column>_a and <column>_b."""
    for end in ("a", "b"):
        pairs = pairs.join(dimension.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end, "left")
    return pairs


def relative_features(numbers: list[str], equal: list[str], day: str | None = None) -> list[Column]:
    """|ln(a / b)| of positive numbers, equality with null as false, and days apart."""
    out = [F.when((F.col(f"{c}_a") > 0) & (F.col(f"{c}_b") > 0), F.abs(F.ln(F.col(f"{c}_a") / F.col(f"{c}_b")))).alias(f"{c}_gap") for c in numbers]
    out += [F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)).alias(f"same_{c}") for c in equal]
    return out + ([F.abs(F.datediff(f"{day}_a", f"{day}_b")).alias("days_apart")] if day else [])


def spread(df: DataFrame, group: str, value: str, most: float) -> DataFrame:
    """(group, n, low, high) of groups with a relative spread of a positive value beyond `most`."""
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.where((F.col("n") > 1) & (F.col("high") > F.col("low") * most))
