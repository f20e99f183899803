"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document. Every word goes that lies in a window whose word sequence
also starts anywhere else, in the same document or another. The positions modulo `period` that belong to a difference
cover are anchors: for any two places of a match at least one offset below `period` puts both on cover positions, so
any two equal windows share an aligned anchor of window - period + 1 words. Anchors seen once rule windows out;
the windows around the others are extended to their full width and compared by 96 bits of hash.

Places are reduced where they are read: of the places that share a hash in a task's buffer, all are known to repeat at
once and only one goes to the range of its hash, so a passage that a third of the documents holds adds one entry for
each buffer (about 50 MB of text) to a range, and no pairs are made. Exchanges carry packed slices, and ranges are dealt
to tasks by number, so that tasks get equal shares.

Defined results: null and empty texts have no words, none removed and an empty kept text. Texts shorter than the
window lose nothing. Repeated rows are places of their own, so both copies lose all windows. Ties do not arise.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import bounded_batches, packed, partitions, row_key, schemas, text_chunks, unpacked, window_hashes, word_hashes

WINDOW, PERIOD = 35, 21
#: Bytes of text for each range of hashes, which is what a task holds of an exchange at once, ranges for each task, and
#: entries that are reduced together before an exchange.
RANGE_BYTES, RANGES_A_TASK, BUFFER = 32 << 20, 4, 2_000_000


def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest, first set of residues whose differences give every residue of the period."""
    for size in range(isqrt(period), period + 1):
        for rest in combinations(range(1, period), max(0, size - 1)):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    return (0,)


def places(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the documents: its document, its position there, and the words from it to the end."""
    lengths = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    doc = np.repeat(np.arange(len(docs)), lengths)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(doc)) - starts[doc]
    return doc, at, lengths[doc] - at


#: Packed places: `h` and `g` are hashes, null for places that are known to repeat; `k` documents and `pos` positions.
PLACES = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("k", pa.binary()), ("pos", pa.binary())])


def repeats(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the hashes, which of the ordered ones occur more than once, and which are the first of their kind."""
    order = np.lexsort((g, h)) if len(g) else np.argsort(h, kind="stable")
    h, g = h[order], g[order] if len(g) else g
    same = h[1:] == h[:-1]
    if len(g):
        same &= g[1:] == g[:-1]
    again, first = np.zeros(len(h), dtype=bool), np.ones(len(h), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    first[1:] = ~same
    return order, again, first


def unique_places(k: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pos, k))
    k, pos = k[order], pos[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (pos[1:] != pos[:-1])
    return k[new], pos[new]


def known(k: np.ndarray, pos: np.ndarray, ranges: int) -> Iterator[dict]:
    """Places that repeat, packed by ranges of documents; copies of one row have equal places, so one is enough."""
    k, pos = unique_places(k, pos)
    yield from ({"h": None, "g": None, **row} for row in packed(k.view(np.uint64), ranges, k=k, pos=pos))


class Buffer:
    """Places of one task, reduced before they leave it."""

    def __init__(self, wide: bool, ranges: int):
        self.wide, self.ranges, self.parts, self.size = wide, ranges, [], 0

    def add(self, h: np.ndarray, g: np.ndarray, k: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((h, g, k, pos))
        self.size += len(h)

    def rows(self) -> pa.RecordBatch:
        h, g, k, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, t) for t in ("<u8", "<u4", "<i8", "<i4"))
        self.parts, self.size = [], 0
        order, again, first = repeats(h, g)
        h, k, pos = h[order], k[order], pos[order]
        columns = {"h": h[first], "k": k[first], "pos": pos[first]} | ({"g": g[order][first]} if self.wide else {})
        sent = ({"g": None, **row} for row in packed(h[first], self.ranges, **columns))
        return pa.RecordBatch.from_pylist([*sent, *known(k[again], pos[again], self.ranges)], schema=PLACES)


def anchor_rows(window: int, period: int, ranges: int):
    width, is_cover = window - period + 1, np.isin(np.arange(period), difference_cover(period))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(False, ranges)
        for batch, texts in text_chunks(batches):
            docs = [words if len(words := t.split()) >= window else [] for t in texts]
            keys = batch.column(batch.schema.get_field_index("k")).to_numpy()
            doc, at, left = places(docs)
            h = window_hashes(word_hashes(docs), width)
            use = np.flatnonzero(is_cover[at[: len(h)] % period] & (left[: len(h)] >= width))
            buffer.add(h[use], np.zeros(0, dtype="<u4"), keys[doc[use]], at[use].astype("<i4"))
            if buffer.size >= BUFFER:
                yield buffer.rows()
        yield buffer.rows()

    return run


def repeated_rows(wide: bool, ranges: int):
    """Of a range of hashes, the places of those that occur more than once, packed by ranges of documents."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.filter(pc.is_null(table.column("h")))
        open_rows = table.filter(pc.is_valid(table.column("h")))
        h, k, pos = unpacked(open_rows, "h", "<u8"), unpacked(open_rows, "k", "<i8"), unpacked(open_rows, "pos", "<i4")
        order, again, _ = repeats(h, unpacked(open_rows, "g", "<u4") if wide else np.zeros(0, dtype="<u4"))
        k = np.concatenate([k[order][again], unpacked(settled, "k", "<i8")])
        pos = np.concatenate([pos[order][again], unpacked(settled, "pos", "<i4")])
        return pa.Table.from_pylist(list(known(k, pos, ranges)), schema=PLACES)

    return run


def gathered_rows(table: pa.Table) -> pa.Table:
    """The places of a range of documents, as one row for each document."""
    k, pos = unique_places(unpacked(table, "k", "<i8"), unpacked(table, "pos", "<i4"))
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    lists = [pos[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.table({"k": pa.array(k[edges[:-1]]), "found": pa.array(lists, pa.binary())})


def marked(lists: list[bytes | None], lengths: list[int], before: int, after: int, last: int) -> np.ndarray:
    """Which places lie from `before` ahead of a given position to `after` behind it, and at least `last` from the end."""
    out = []
    for parts, n in zip(lists, lengths, strict=True):
        step = np.zeros(n + 1, dtype=np.int64)
        if parts and n > last:
            pos = np.frombuffer(parts, dtype="<i4")
            step += np.bincount(np.maximum(pos - before, 0), minlength=n + 1)[: n + 1]
            step -= np.bincount(np.minimum(pos + after, n - last - 1) + 1, minlength=n + 1)[: n + 1]
        out.append(np.cumsum(step[:-1]) > 0)
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def window_rows(window: int, period: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(True, ranges)
        for batch, texts in text_chunks(batches):
            docs = [t.split() for t in texts]
            keys = batch.column(batch.schema.get_field_index("k")).to_numpy()
            found = batch.column(batch.schema.get_field_index("found")).to_pylist()
            doc, at, _ = places(docs)
            words = word_hashes(docs)
            use = np.flatnonzero(marked(found, list(map(len, docs)), period - 1, 0, window - 1))
            buffer.add(window_hashes(words, window)[use], window_hashes(words, window, 1)[use].astype("<u4"), keys[doc[use]], at[use].astype("<i4"))
            if buffer.size >= BUFFER:
                yield buffer.rows()
        yield buffer.rows()

    return run


def kept_rows(window: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found = batch.column(batch.schema.get_field_index("found")).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, parts in zip(texts, found, strict=True):
                words = text.split()
                gone = 0
                if parts:
                    drop = marked([parts], [len(words)], 0, window - 1, 0)
                    gone = int(drop.sum())
                    words, n = [w for w, x in zip(words, drop.tolist(), strict=True) if not x], len(words)
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """One row per document: its id, n_words, n_removed and kept_text, the kept words joined by one space."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("k"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(partitions(spark), size // RANGE_BYTES + 1)
    tasks = max(partitions(spark), ranges // RANGES_A_TASK)
    kinds = "bucket int, h binary, g binary, k binary, pos binary"

    def found(rows: DataFrame, wide: bool) -> DataFrame:
        """Of each document with repeated hashes, the positions that have them."""
        again = rows.repartitionById(tasks, "bucket").groupBy("bucket").applyInArrow(repeated_rows(wide, ranges), kinds)
        return again.repartitionById(tasks, "bucket").groupBy("bucket").applyInArrow(gathered_rows, "k long, found binary")

    anchors = found(keyed.select("k", "text").mapInArrow(anchor_rows(window, period, ranges), kinds), wide=False)
    near = keyed.join(anchors.hint("merge"), "k")
    windows = found(near.mapInArrow(window_rows(window, period, ranges), kinds), wide=True)
    spark_schema, arrow = schemas({"id": keyed.schema["id"].dataType, "n_words": "long", "n_removed": "long", "kept_text": "string"})
    out = keyed.join(windows.hint("merge"), "k", "left").mapInArrow(kept_rows(window, arrow), spark_schema)
    return out.withColumnRenamed("id", id_col)
