"""Nearest neighbours of a whole corpus of vectors by an inverted file: cells around centroids, a few cells per query.

Centroids are fitted on a bounded sample, one for about CELL vectors; every vector lies in the cell of its nearest
centroid, and as a query looks into its PROBES nearest cells. A cell's vectors meet its queries in slices and blocks of
bounded size, each of which keeps k per query, so what is shuffled is k rows per query, cell and slice. A task works out
PRODUCTS cosines at once, whatever the size of its batches, slices and blocks. Equal vectors are one
class from the start and are compared once. Results are exact within the probed cells; recall against brute force is
measured in tests. For a stated set of queries with exact results see pairs.nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import cut

#: Vectors that centroids are fitted on at most, vectors of a cell on average, cells at most, and rounds of the fit.
SAMPLE, CELL, MOST_CELLS, ROUNDS = 20_000, 64, 4096, 8
#: Cells that a query looks into, vectors and queries of a cell that meet in one group, and cosines in memory at once.
PROBES, SLICE, BLOCK, PRODUCTS = 24, 8192, 16_384, 1 << 20


def unit_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros((0, 1))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def row_blocks(rows: int, columns: int) -> Iterator[slice]:
    """Runs of rows whose products with all columns are PRODUCTS at most (one row at least)."""
    step = max(1, PRODUCTS // max(1, columns))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def centroids_of(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors starts anew at one of the worst served."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own, fit = np.empty(len(sample), dtype=np.int64), np.empty(len(sample))
        for some in row_blocks(len(sample), len(centres)):
            near = sample[some] @ centres.T
            own[some], fit[some] = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def probed_rows(shared, probes: int):
    """Of each vector the nearest cells, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        most = min(probes, len(centres))
        for batch in batches:
            own = unit_matrix(batch.column(batch.schema.get_field_index("v")))
            cells = np.zeros((batch.num_rows, most), dtype=np.int64)
            for some in row_blocks(batch.num_rows, len(centres)):
                far = -(own[some] @ centres.T)
                first = np.sort(np.argpartition(far, most - 1, axis=1)[:, :most], axis=1)
                order = np.argsort(np.take_along_axis(far, first, axis=1), axis=1, kind="stable")
                cells[some] = np.take_along_axis(first, order, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * most, pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cells"])

    return run


def best_rows(k: int):
    def run(asked: pa.Table, base: pa.Table) -> pa.Table:
        if not len(asked) or not len(base):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        a, b = asked.column("node").to_numpy(), base.column("b_node").to_numpy()
        x, y = unit_matrix(asked.column("v")), unit_matrix(base.column("b_v")).T
        found = []
        for some in row_blocks(len(a), len(b)):
            own, sims = a[some], x[some] @ y
            sims[own[:, None] == b[None, :]] = -np.inf
            least = np.partition(sims, max(0, len(b) - k), axis=1)[:, max(0, len(b) - k)]
            rows, columns = np.nonzero((sims >= least[:, None] - 1e-11) & np.isfinite(sims))
            found.append(pa.table({"a": own[rows], "b": b[columns], "cosine": sims[rows, columns]}))
        return pa.concat_tables(found)

    return run


def neighbours(df: DataFrame, item: str, vector: str, k: int, probes: int = PROBES) -> DataFrame:
    """(query, item, cosine, rank): of each vector about its k nearest others, ties by item. Vectors have one length;
    null, empty, zero and non-finite ones have no neighbours and are none."""
    spark = df.sparkSession
    v = F.col("v")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(item).cast("long").alias("item"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("item").isNotNull() & usable)
    rows = cut(rows.withColumn("key", F.xxhash64("v")), "vectors")
    # One class for each vector, named by its smallest item; members come back as neighbours at cosine 1.
    classes = cut(rows.groupBy("key", "v").agg(F.min("item").alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    count = classes.count()
    if not count:
        return spark.createDataFrame([], "query long, item long, cosine double, rank int")
    chosen = classes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, count // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).toArrow()
    sample = unit_matrix(chosen.column("v")) if chosen.num_rows else unit_matrix(classes.select("v").limit(1).toArrow().column("v"))
    centres = spark.sparkContext.broadcast(centroids_of(sample, max(1, min(MOST_CELLS, count // CELL))))
    placed = cut(classes.select("node", "v").mapInArrow(probed_rows(centres, probes), "node long, v array<double>, cells array<long>"), "placed")
    parts = lambda most, name: F.ceil(F.count(F.lit(1)) / most).cast("long").alias(name)
    sizes = placed.groupBy(F.col("cells")[0].alias("cell")).agg(parts(SLICE, "slices"))
    sizes = sizes.join(placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(parts(BLOCK, "blocks")), "cell")
    sizes = cut(sizes, "cells")  # cells at most
    base = placed.select("node", "v", F.col("cells")[0].alias("cell")).join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    asked = placed.select("node", "v", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["cell", "slice", "block"]
    base = base.select(*[F.col(c).alias(f"b_{c}") for c in keys], F.col("node").alias("b_node"), F.col("v").alias("b_v"))
    near = asked.select(*keys, "node", "v").groupBy(*keys).cogroup(base.groupBy(*[f"b_{c}" for c in keys])).applyInArrow(best_rows(k), "a long, b long, cosine double")
    order = lambda tie: Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 12)), tie)
    near = cut(near.withColumn("r", F.row_number().over(order("b"))).where(F.col("r") <= k).drop("r"), "near")

    # Classes back to items: others of the own class first, then members of near classes, the k smallest of each.
    members = rows.join(classes.select("key", F.col("v").alias("__v"), "node"), "key").where(F.col("v") == F.col("__v")).select("node", "item")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("item"))).where(F.col("r") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list("item")).alias("items"))
    own = classes.where("size > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("cosine"))
    found = near.unionByName(own).join(first.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.collect_list(F.struct("cosine", "items")).alias("lists"))
    out = members.join(found, members["node"] == found["a"]).select(F.col("item").alias("query"), F.explode("lists").alias("l"))
    out = out.select("query", "l.cosine", F.explode("l.items").alias("item")).where("item <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "item"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "item", "cosine", "rank")
