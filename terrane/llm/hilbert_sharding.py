"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised to `bits` bits each, the cell's index on the Hilbert curve through them is
the sort key, and equal runs of that order are the shards, so a shard covers a compact region of all dimensions and
min/max statistics prune files on ranges of any numeric one. Numbers are quantised by the logarithm of their value
between fixed bounds, strings by hash, so nothing is fitted and a row's cell depends on the row alone; hashed strings
keep rows of equal values together, which prunes on equality of few-valued ones by their sets of values, not by order.

Counts of shards are at most one apart (law `rows`). Rows are ranked by a range sort whose keys end with the row's
hash and id, so a cell that holds a third of all rows is split over many tasks; only one count per task meets the driver.

Defined results: a null text has size 1 and the CRC of the empty text. Null metadata fall into the lowest cell of their
dimension. Equal rows take neighbouring slots, in any order among themselves. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import partitions
from terrane.session import cut

SHARDS, BITS = 16, 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of cell coordinates (rows x dimensions), each below 2 ** bits."""
    x = [c.astype(np.int64) for c in cells.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of the sub-cubes, from the largest down
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    fix, q = np.zeros_like(x[0]), top
    while q > 1:
        fix ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ fix) >> bit) & 1)
    return index


def cell(value: Column, kind: str, bits: int) -> Column:
    """A dimension's coordinate, 0 to 2 ** bits - 1."""
    most = (1 << bits) - 1
    if kind == "string":
        return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(most)) + 1).cast("int")
    grade = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1) * (most / 40.0))
    return F.when(value.isNull() | F.isnan(value.cast("double")), 0).otherwise(F.least(grade, F.lit(most))).cast("int")


def curve_index(cells: list[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*cells)


def shard(docs: DataFrame, dimensions: list[str], id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document: id, size, text_crc32, curve (the Hilbert index), law, shard, slot and grown_shard."""
    spark = docs.sparkSession
    kinds = {c: "string" if docs.schema[c].dataType.simpleString() == "string" else "number" for c in dimensions}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[cell(F.col(c), kinds[c], bits).alias(f"cell{i}") for i, c in enumerate(dimensions)])
    rows = rows.select("id", "size", "text_crc32", curve_index([F.col(f"cell{i}") for i in range(len(dimensions))], bits).alias("curve"))
    keys = ["curve", "text_crc32", "id", "size"]
    ordered = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    # The place within a task is the low part of Spark's increasing id; the written copy fixes both parts.
    place = F.monotonically_increasing_id()
    ordered = cut(ordered.select("*", place.alias("place")), "ordered")
    part = F.shiftright("place", 33)
    counts = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, starts = 0, []
    for number, n in counts:
        starts.append((number, total))
        total += n
    offsets = spark.createDataFrame(starts, "part long, before long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div {max(total, 1)}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
