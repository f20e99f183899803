"""Benchmark decontamination with training suffix arrays.

A task reads its documents in shards of about SHARD_BYTES of text and builds the suffix array of each: the places of
its words, sorted by all words that follow, by prefix doubling. Every suffix of every benchmark item is binary-searched
in every shard, which gives the run of places that begin with its window; of each place found, the neighbours in order
among suffixes that begin with a window give the longest verbatim match and where in which item it lies. Matches inside
another are left out. Words that no item has end a suffix, and stretches
shorter than any window stay out of the array, which changes no result.

The benchmark goes to the tasks in blocks of at most `block_words` words, one pass over the documents for each, written
before the next begins, so what is broadcast and what a task holds have a fixed bound however large the benchmark is.
Longest matches of several blocks are merged by document, as one block would give them. Places and items are kept as
sets, so a window that many places and many items share costs their sum.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A window is
`window` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: null and empty texts have no words and are clean. Items that are null or without words have no window.
Items of equal text all count. A null item id counts as an item named by the empty string. Repeated rows are judged
alike. Of several longest matches of a place one is named. Empty tables: no documents give no rows, no items leave all
documents clean. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import bounded_batches, schemas, text_chunks
from terrane.session import cut

WINDOW, SHARE = 13, 20
#: Words of the benchmark that a pass broadcasts.
BLOCK_WORDS = 2_000_000
#: Bytes of text in a shard.
SHARD_BYTES = 6 << 20

#: Word bytes map to themselves or their lower case, all others to a space.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() and c < 0x80 else 32 for c in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Suffixes:
    """A block of items as one sequence of word numbers, 0 after each item; and which items own each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        split = [(item, w) for item, text in items if (w := split_words(text))]
        self.window, self.ids = window, [item for item, _ in split]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.words = np.array([n for _, ws in split for n in [*map(self.number.__getitem__, ws), 0]], dtype=np.int64)
        lengths = np.array([len(ws) for _, ws in split], dtype=np.int64)
        self.longest = int(lengths.max()) if len(lengths) else 0
        self.item = np.repeat(np.arange(len(split)), lengths + 1)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        left = (self.start + lengths)[self.item] - np.arange(len(self.words)) if len(split) else np.zeros(0, dtype=np.int64)
        self.windows = {int(w): np.flatnonzero((left == w) & (lengths[self.item] == w)) for w in np.unique(lengths[lengths < window])}
        if (lengths >= window).any():
            self.windows[window] = np.flatnonzero(left >= window)


class Shard:
    """The suffix array of the documents' stretches of benchmark words, ranked together with the benchmark's suffixes."""

    def __init__(self, suffixes: Suffixes, docs: list[list[bytes]]):
        self.suffixes = suffixes
        lengths = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        number = suffixes.number.get
        words = np.fromiter((x for d in docs for x in [*(number(w, 0) for w in d), 0]), dtype=np.int64, count=int((lengths + 1).sum()))
        gap = np.flatnonzero(words == 0)  # the next word that no item has, or the document's end
        begin = np.append(0, gap[:-1] + 1)
        long = gap - begin >= min(suffixes.windows, default=1)
        use = np.repeat(long, gap - begin + 1)
        self.doc = np.repeat(np.arange(len(docs)), lengths + 1)[use]
        self.place = (np.arange(len(words)) - (np.cumsum(lengths + 1) - lengths - 1)[np.repeat(np.arange(len(docs)), lengths + 1)])[use]
        self.words = words[use]
        ends = np.flatnonzero(self.words == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(self.words)))] - np.arange(len(self.words)) if len(ends) else np.zeros(0, dtype=np.int64)
        self.n = len(self.words)
        self.levels = [np.concatenate([self.words, suffixes.words])]  # level k ranks all suffixes by their first 2 ** k words
        while self.n and (1 << (len(self.levels) - 1)) < suffixes.longest:
            rank, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if int(rank.max()) + 1 == len(rank):
                break
            after = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])
            self.levels.append(np.unique(rank * (int(rank.max()) + 2) + after + 1, return_inverse=True)[1])

    def prefix(self, width: int) -> np.ndarray:
        """A number of each suffix that tells its first `width` words, rising with the order of the suffixes."""
        level = min(width.bit_length() - 1, len(self.levels) - 1)
        key, done = self.levels[level], 1 << level
        while done < width:
            step = min(width - done, 1 << level)
            after = np.concatenate([self.levels[level][done - (1 << level) + step :], np.full(done - (1 << level) + step, -1)])
            key = np.unique(key * (int(after.max(initial=0)) + 2) + after + 1, return_inverse=True)[1]
            done += step
        return key

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and at b have in common, to the end of a's stretch at most."""
        total, limit = np.zeros(len(a), dtype=np.int64), len(self.levels[0]) - 1
        for level in [len(self.levels) - 1, *range(len(self.levels) - 1, -1, -1)]:
            x, y = np.minimum(a + total, limit), np.minimum(b + total, limit)
            total += np.where(self.levels[level][x] == self.levels[level][y], 1 << level, 0)
        return np.minimum(total, self.left[a])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Places of the shard that begin a window, how many words from there on windows cover, where the widest of these
        begins in the benchmark, and (document, item)."""
        s = self.suffixes
        covered, source, owners = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64), []
        array = np.argsort(self.levels[-1][: self.n], kind="stable")
        for width, starts in s.windows.items():
            key = self.prefix(width)
            ordered, searched = key[: self.n][array], key[self.n + starts]
            low, high = np.searchsorted(ordered, searched, "left"), np.searchsorted(ordered, searched, "right")
            hit = high > low
            if not hit.any():
                continue
            runs, which = np.unique(low[hit], return_index=True)
            ends = high[hit][which]
            at = array[np.repeat(runs - np.append(0, np.cumsum(ends - runs)[:-1]), ends - runs) + np.arange((ends - runs).sum())]
            run = np.repeat(np.arange(len(runs)), ends - runs)
            whole = self.left[at] >= width
            at, run = at[whole], run[whole]
            covered[at], source[at] = width, starts[hit][which][run]  # widths rise
            # Windows of the same items are one; a document meets each once, whatever the number of its places.
            items = [np.unique(x) for x in np.split(s.item[starts[hit]][np.argsort(low[hit], kind="stable")], np.cumsum(np.unique(low[hit], return_counts=True)[1])[:-1])]
            names: dict[bytes, int] = {}
            group = np.array([names.setdefault(x.tobytes(), len(names)) for x in items])
            sets = [np.frombuffer(x, dtype=np.int64) for x in names]
            pair = np.unique(np.stack([self.doc[at], group[run]], axis=1), axis=0)
            owners.append((np.repeat(pair[:, 0], [len(sets[g]) for g in pair[:, 1]]), np.concatenate([sets[g] for g in pair[:, 1]]) if len(pair) else pair[:, 1]))
        return np.flatnonzero(covered), covered, source, owners

    def longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of places that begin a full window with any suffix that does, and where that begins."""
        starts = self.suffixes.windows[self.suffixes.window]
        own = self.levels[-1][self.n + starts]
        order = np.argsort(own, kind="stable")
        place = np.searchsorted(own[order], self.levels[-1][at])
        before, after = (starts[order[np.clip(p, 0, len(order) - 1)]] for p in (place - 1, place))
        a, b = self.common(at, self.n + before), self.common(at, self.n + after)
        return np.maximum(a, b), np.where(b >= a, after, before)


def shard_rows(suffixes: Suffixes, docs: list[list[bytes]]) -> tuple[list[list[dict]], list[list[dict]], list[list[str]]]:
    """Of each document: its longest matches, none inside another, what windows cover, and the items."""
    matches, hits, items = ([[] for _ in docs] for _ in range(3))
    shard = Shard(suffixes, docs)
    if not shard.n:
        return matches, hits, items
    at, covered, begin, owners = shard.found()
    if not len(at):
        return matches, hits, items
    length, begin = covered[at], begin[at]
    full = length == suffixes.window
    if full.any():
        length[full], begin[full] = shard.longest(at[full])
    ends = np.maximum.accumulate(at + length)
    widest = np.append(True, at[1:] + length[1:] > ends[:-1])
    for p, n, t in zip(at[widest].tolist(), length[widest].tolist(), begin[widest].tolist(), strict=True):
        item = int(suffixes.item[t])
        matches[shard.doc[p]].append({"start": int(shard.place[p]), "length": n, "item_id": suffixes.ids[item], "item_start": t - int(suffixes.start[item])})
    step = np.zeros(shard.n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + covered[at], -1)
    inside = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
    for a, b in zip(np.flatnonzero(inside > 0).tolist(), np.flatnonzero(inside < 0).tolist(), strict=True):
        hits[shard.doc[a]].append({"start": int(shard.place[a]), "length": b - a})
    pairs = np.unique(np.concatenate([np.stack(pair, axis=1) for pair in owners]), axis=0)
    for d, item in pairs.tolist():
        items[d].append(suffixes.ids[item])
    return matches, hits, items


def merged_matches(matches: list[dict]) -> list[dict]:
    """The matches of several blocks without those that lie inside another, as one block would give them."""
    kept, end = [], -1
    for m in sorted(matches, key=lambda m: (m["start"], -m["length"])):
        if m["start"] + m["length"] > end:
            kept.append(m)
            end = m["start"] + m["length"]
    return kept


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("matches")
        made = pa.array([merged_matches(m) for m in batch.column(i).to_pylist()], batch.schema.field(i).type)
        yield batch.set_column(i, batch.schema.field(i), made)


def matching_rows(suffixes: Suffixes, schema: pa.Schema):
    """The matches with one block of the benchmark, a shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, list[list[bytes]]]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            found, first = shard_rows(suffixes, [d for _, docs in waiting for d in docs]), 0
            for batch, docs in waiting:
                matches, hits, items = (x[first : first + len(docs)] for x in found)
                first += len(docs)
                made = {"n_words": [len(d) for d in docs], "matches": matches, "hits": hits, "items": items}
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *(pa.array(made[name], schema.field(name).type) for name in schema.names[1:])], schema=schema)
            waiting.clear()

        for batch, texts in text_chunks(batches):
            waiting.append((batch.select(["id"]), [split_words(t) for t in texts]))
            size += sum(map(len, texts))
            if size >= SHARD_BYTES:
                yield from rows()
                size = 0
        yield from rows()

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    block, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    for row in rows.toLocalIterator():
        text = row.text.encode()
        block.append((row.item, text))
        words += len(text) // 2 + 1
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


COLUMNS = {"n_words": "long", "matches": "array<struct<start:long,length:long,item_id:string,item_start:long>>", "hits": "array<struct<start:long,length:long>>", "items": "array<string>"}


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, matches, hits, items): each document with its longest verbatim matches where windows occur, the
    stretches that windows cover, places in words, and the items that the windows belong to."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    block, after = next(blocks, []), next(blocks, None)

    def one_pass(rows: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
        spark_schema, arrow = schemas({"id": rows.schema["id"].dataType} | COLUMNS)
        return rows.mapInArrow(matching_rows(Suffixes(items, window), arrow), spark_schema)

    if after is None:
        return one_pass(source, block).withColumnRenamed("id", id_col)
    rows = cut(source.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "documents")
    numbered, parts = rows.select(F.col("row").alias("id"), "text"), None
    while block is not None:
        part = cut(one_pass(numbered, block).where(F.size("hits") > 0), "matches")
        parts = part if parts is None else parts.unionByName(part)
        block, after = after, next(blocks, None)
    every = lambda name: F.flatten(F.collect_list(name)).alias(name)  # noqa: E731  one entry for each block
    merged = parts.groupBy("id").agg(F.max("n_words").alias("n_words"), every("matches"), every("hits"), every("items"))
    words = cut(one_pass(numbered, []).select(F.col("id").alias("row"), F.col("n_words").alias("all_words")), "words")
    merged = merged.mapInArrow(merged_rows, merged.schema)
    out = rows.select("row", "id").join(words, "row").join(merged.withColumnRenamed("id", "row"), "row", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(COLUMNS[name])).alias(name)
    return out.select(F.col("id").alias(id_col), F.col("all_words").alias("n_words"), empty("matches"), empty("hits"), empty("items"))


def hit_words(stretches: Column) -> Column:
    """How many words lie in at least one of the stretches."""
    ordered = F.array_sort(F.transform(stretches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))

    def step(acc: Column, m: Column) -> Column:
        gain = F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(m["a"], acc["end"]))
        return F.struct(F.greatest(acc["end"], m["b"]).alias("end"), (acc["hit"] + gain).alias("hit"))

    return F.aggregate(ordered, zero, step, lambda acc: acc["hit"])


def judge(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_words, n_hit, item_ids (sorted as strings) and contaminated, from matches."""
    items = F.array_sort(F.array_distinct("items"))
    out = found.withColumn("n_hit", hit_words(F.col("hits"))).withColumn("item_ids", items)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    whole = docs.select(F.struct("*").alias("id"), F.col(text_col).alias("text"))
    found = judge(find_matches(whole, benchmark, "id", "text"))
    return found.where("not contaminated").select("id.*")
