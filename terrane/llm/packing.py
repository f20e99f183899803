"""Bounded-space online packing of token sequences.

Each partition streams its documents once. A document is its token ids and the separator id 0; every full sequence's
worth of ids is a sequence of its own, and the rest is placed best-fit into one of `open_windows` open sequences. When
it fits none, the fullest is emitted as it is and a new one opens. What is still open when partitions end is merged:
the leftovers of all partitions are dealt into groups of a bounded number and packed whole, largest first.

Words are tokenized once per worker and reused, which cannot change ids: a text is cut only where the tokenizer's own
pattern always cuts, before a single space and around a single line break. Texts with any other white space next to
white space go to the tokenizer whole, and so do texts that spell one of its added tokens, such as an end-of-text mark.
These get the ids that the tokenizer's file gives them; with `literal` they are ordinary text.

Defined results: a null or empty text is the separator alone. Texts of any length are cut at sequence ends. Repeated
rows are packed each. Which sequence a document shares depends on row order; contents of pieces do not. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import CACHE_WORDS, bounded_batches, schemas, worker_cache
from terrane.session import cut

LENGTH, OPEN_WINDOWS = 1024, 64
#: Leftover windows that one task merges, on average.
MERGE_WINDOWS = 4096
#: White space other than a space and a line break.
RARE_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer's file, and the file with the same vocabulary as ranks for single words."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordIds(dict):
    """Ids of a word, little-endian, computed once; `before` stands ahead of it in the text."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = np.array(self.encode(self.before + word), dtype="<u4").tobytes()
        return value


class TextIds:
    """Token ids of texts, as little-endian 32-bit words."""

    def __init__(self, files: tuple[str, str], literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(files[0])
        self.whole.encode_special_tokens = literal
        self.added = tuple(token.content for token in self.whole.get_added_tokens_decoder().values())
        with open(files[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain, self.spaced = WordIds(encode, ""), WordIds(encode, " ")
        self.line = np.array(encode("\n"), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACES) or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out, spaced = [], self.spaced.__getitem__
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if i:
                out.append(self.line)
            if words[0]:
                out.append(self.plain[words[0]])
            out.extend(map(spaced, words[1:]))
        return b"".join(out)


class Windows:
    """Open windows of one partition, by what is free in them."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.next = length, most, 0
        self.open: list[tuple[int, int]] = []  # (free, window), smallest first
        self.closed: list[int] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        """The window of a piece, and where it begins there."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.closed.append(self.open.pop(0)[1])
            free, window = self.length, self.new()
        if free > size:
            insort(self.open, (free - size, window))
        else:
            self.closed.append(window)
        return window, self.length - free


def piece_rows(files: tuple[str, str], literal: bool, length: int, most: int, keep_ids: bool, schema: pa.Schema):
    """Pieces as they are placed; the last row of a partition names the windows that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("ids_of") != (files, literal):
            cache |= {"ids_of": (files, literal), "ids": TextIds(files, literal)}
        encode, windows, part = cache["ids"], Windows(length, most), TaskContext.get().partitionId() << 32
        ids = schema.field("id").type
        waiting: dict[int, list[tuple]] = {}

        def rows(out: list[tuple], still_open: bool) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            arrays = [pa.array(columns[0], ids), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array([still_open] * len(out), pa.bool_())]
            if keep_ids:
                arrays.append(pa.array(columns[7] if out else [], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names = batch.column(batch.schema.get_field_index("id")).to_pylist()
            for name, text in zip(names, texts, strict=True):
                tokens = (encode(text) if text else b"") + b"\0\0\0\0"
                total = len(tokens) // 4
                for start in range(0, total, length):
                    piece = tokens[4 * start : 4 * (start + length)]
                    size = len(piece) // 4
                    if size == length:
                        window, offset = windows.new(), 0
                        windows.closed.append(window)
                    else:
                        window, offset = windows.place(size)
                    row = (name, start, size, crc32(piece), total, part | window, offset)
                    waiting.setdefault(window, []).append((*row, piece) if keep_ids else row)
            done = [row for window in windows.closed for row in waiting.pop(window)]
            windows.closed.clear()
            if done:
                yield rows(done, False)
        yield rows([row for own in waiting.values() for row in own], True)

    return run


def merged_rows(length: int):
    """Best fit, largest first, of whole windows: where each of a group's windows goes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fill, window = table.column("fill").to_pylist(), table.column("window").to_pylist()
        order = sorted(range(len(fill)), key=lambda i: (-fill[i], window[i]))
        merged = Windows(length, len(fill) + 1)
        first = (1 << 62) | (key[0].as_py() << 32)
        placed = [merged.place(fill[i]) for i in order]
        return pa.table({"window": pa.array([window[i] for i in order], pa.int64()), "sequence_id": pa.array([first | w for w, _ in placed], pa.int64()), "shift": pa.array([s for _, s in placed], pa.int64())})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_windows: int = OPEN_WINDOWS, files: tuple[str, str] | None = None, keep_ids: bool = False, literal: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (bytes) if asked for."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = {"id": source.schema["id"].dataType, "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "window": "long", "offset": "long", "open": "boolean"}
    spark_schema, arrow = schemas(columns | ({"ids": "binary"} if keep_ids else {}))
    pieces = cut(source.mapInArrow(piece_rows(files or default_tokenizer(), literal, length, open_windows, keep_ids, arrow), spark_schema), "pieces")
    left = pieces.where("open")
    open_rows = left.groupBy("window").agg(F.sum("length").alias("fill"))
    groups = open_rows.count() // MERGE_WINDOWS + 1
    dealt = open_rows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(groups)))
    merged = dealt.groupBy("part").applyInArrow(merged_rows(length), "window long, sequence_id long, shift long")
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    whole = pieces.where("not open").withColumn("sequence_id", F.col("window")).select(*kept)
    rest = left.join(merged, "window").withColumn("offset", F.col("offset") + F.col("shift")).select(*kept)
    return whole.unionByName(rest).withColumnRenamed("id", id_col)
