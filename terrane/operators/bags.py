"""Hashed bags of words: counts of the slots that the words of a text fall into.

A task hashes each different word of a stretch of texts once and counts the slots of each text there, so what is
shuffled is one short list for each row; rows of one text id meet in one shuffle, in which their lists are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text and rows that are counted at once, about, and words whose slots a task keeps.
BYTES, ROWS, KEPT = 1 << 22, 2048, 200_000
#: Texts of a task in which the lists of one text id meet; a text has as many entries as slots at most.
TASK_TEXTS = 10_000
WORD = np.zeros(256, dtype=bool)
WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def slot_of(word: str, slots: int) -> int:
    """The same as functions.scalars.bag_slot."""
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big") % slots


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [a-z0-9]+ of texts as one array, and the row of each."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = WORD[data]
    after = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after[ends[:-1][ends[:-1] < len(data)]] = False  # a text begins anew
    starts = np.flatnonzero(inside & ~after)
    offsets = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.searchsorted(ends[1:], starts, "right")


def bag_rows(slots: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
            before, start = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
            while start < batch.num_rows:
                stop = min(start + ROWS, max(start + 1, int(np.searchsorted(before, before[start] + BYTES, "right")) - 1), batch.num_rows)
                words, rows = words_of(batch.column(1).slice(start, stop - start))
                words = words.dictionary_encode()
                if len(known) > KEPT:
                    known.clear()
                own = np.empty(len(words.dictionary), dtype=np.int64)
                for i, word in enumerate(words.dictionary.to_pylist()):
                    slot = known.get(word)
                    own[i] = known.setdefault(word, slot_of(word, slots)) if slot is None else slot
                counts = np.bincount(rows * slots + own[words.indices.to_numpy()], minlength=(stop - start) * slots)
                held = np.flatnonzero(counts)
                ends = pa.array(np.searchsorted(held, np.arange(stop - start + 1) * slots), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in ((held % slots).astype(np.int32), counts[held])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *lists], names=names)
                start = stop

    return run


def hashed_bags(docs: DataFrame, doc: str, text: str, slots: int = 384) -> DataFrame:
    """(doc, slot, n, length) of each slot that a text's words [a-z0-9]+, in lower case, fall into, and the length of the
    vector of its counts. Rows of one doc are one text; null texts hold nothing."""
    rows = docs.select(doc, F.lower(text).alias("__text"))
    kind = rows.schema[doc].dataType.simpleString()
    counted = rows.mapInArrow(bag_rows(slots, [doc, "slots", "counts"]), f"`{doc}` {kind}, slots array<int>, counts array<long>")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_TEXTS))
    each = counted.repartition(tasks, doc).select(doc, F.explode(F.arrays_zip("slots", "counts")).alias("c")).select(doc, F.col("c.slots").alias("slot"), F.col("c.counts").alias("n"))
    bags = each.groupBy(doc, "slot").agg(F.sum("n").alias("n"))
    return bags.withColumn("length", F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(doc))))
