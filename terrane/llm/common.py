"""Helpers shared by the text operators: bounded batches, word hashes, window hashes and packed exchanges."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in an Arrow batch and bytes of text that a Python task works on at once.
BATCH_ROWS, CHUNK_BYTES = 256, 4 << 20
#: Words that a worker keeps the hash of; a fuller cache starts anew.
CACHE_WORDS = 400_000

UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts do not fill a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that are looked up by broadcast at most, and rows of one key at least for that.
HOT_KEYS, HOT_ROWS = 20_000, 1000


def attached(rows: DataFrame, found: DataFrame, keys: list[str], held: str, hot: int | None = None) -> DataFrame:
    """rows with found's other columns, null where there is none; found is a written table with one row for each key,
    and `held` tells how many rows have it. Keys of more than `hot` rows, of which there are HOT_KEYS at most unless it
    is given, meet their rows by broadcast; these rows are spread over all tasks of the join that looks up the others."""
    if hot is None:
        hot = max(HOT_ROWS, int(found.agg(F.sum(held)).first()[0] or 0) // HOT_KEYS)
    names = [c for c in found.columns if c not in keys and c != held]
    values = F.struct(*[F.col(c) for c in names])
    named = lambda side: [F.col(k).alias(f"{side}{i}") for i, k in enumerate(keys)]
    heavy = found.where(F.col(held) > hot).select(*named("h"), values.alias("hot_values"))
    light = found.where(F.col(held) <= hot).select(*named("l"), values.alias("values"))
    out = rows.select(F.struct("*").alias("whole"), *named("k"))
    out = out.join(F.broadcast(heavy), [F.col(f"k{i}") == F.col(f"h{i}") for i in range(len(keys))], "left")
    spread = F.when(F.col("hot_values").isNull(), F.col("k0")).otherwise(F.xxhash64(F.monotonically_increasing_id()).cast(found.schema[keys[0]].dataType))
    out = out.withColumn("k0", spread)
    out = out.join(light, [F.col("hot_values").isNull(), *[F.col(f"k{i}") == F.col(f"l{i}") for i in range(len(keys))]], "left")
    got = F.coalesce("hot_values", "values")
    return out.select(*[F.col("whole")[c].alias(c) for c in rows.columns], *[got[c].alias(c) for c in names])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does."""
    return sys.modules.setdefault("_terrane_worker", types.ModuleType("_terrane_worker")).__dict__


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content. Rows that are equal in these columns share it, and share their result."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `size` bytes of text each, and the texts' UTF-8 bytes (null: none)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        values = [x or b"" for x in column.to_pylist()]
        start = held = 0
        for i, value in enumerate(values):
            if i > start and held + len(value) > size:
                yield batch.slice(start, i - start), values[start:i]
                start, held = i, 0
            held += len(value)
        if start < len(values):
            yield batch.slice(start), values[start:]


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word a worker meets."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(docs: list[list[bytes]]) -> np.ndarray:
    """The hashes of all words of the documents, one after another."""
    cache = worker_cache().setdefault("words", WordHashes())
    if len(cache) > CACHE_WORDS:
        cache.clear()
    total = sum(map(len, docs))
    return np.fromiter((h for words in docs for h in map(cache.__getitem__, words)), dtype=np.uint64, count=total)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


#: Odd multipliers of the two window hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of width words; a run is named by its first word."""
    n = len(words)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    base = BASES[which]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n - width + 1)
    return mix((sums[width:] - sums[:-width]) * inverse)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """0 .. n - 1 in the order of the hash, so that sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def packed(by: np.ndarray, n: int, **columns: np.ndarray) -> Iterator[dict]:
    """One row for each bucket of the hash that has entries, with its slices of the columns as bytes."""
    if not len(by):
        return
    order = np.argsort(by)
    columns = {k: v[order] for k, v in columns.items()}
    buckets = bucket_of(by[order], n).astype(np.int64)
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=n))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield {"bucket": int(buckets[a]), **{k: v[a:b].tobytes() for k, v in columns.items()}}


def unpacked(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def schemas(columns: dict[str, T.DataType | str]) -> tuple[T.StructType, pa.Schema]:
    """Spark's and Arrow's schema of these columns; types are given as objects or in DDL."""
    fields = [T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind) for name, kind in columns.items()]
    return T.StructType(fields), to_arrow_schema(T.StructType(fields))
