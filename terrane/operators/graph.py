"""Connected components of an edge table, distributed, with lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import cut, last_cut, remove


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node that it reaches.

    Alternates the large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    size of a component. Minima are pre-aggregated before each shuffle, and a hub's edges may be split over tasks.
    Self-edges, repeated edges, null ends and an empty table are fine: null ends are ignored, the others merge.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    loops = now.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now = now.where("a <> b")
    seen = _mark(now)
    spark, earlier = edges.sparkSession, None
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small, "edges")
        remove(spark, [earlier] if earlier else [])  # the round before last is of no more use
        earlier = last_cut(spark)
        was, seen = seen, _mark(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("root").alias("root"))
