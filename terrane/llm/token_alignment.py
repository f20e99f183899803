"""Alignment of two tokenizers over the same text, and how usual each pair of linked ids is in the corpus.

Both tokenizers cut the bytes of a space and the text. Two pointers walk over the cumulative ends of both: where both
end, a group ends, and between two neighbouring ends of either side exactly one token of each side lies, which is a
link.

Spark then counts in how many documents each id pair is linked, takes the highest count of each id on either side, and
joins these back to the links. Usual pairs, of which there are LOOKUP_KEYS at most whatever the input, meet their links
by broadcast; the others by a shuffle join.

Defined results: texts that are null or empty, or whose tokens do not give back the bytes of space and text on one of
the sides (a text with U+2581, for one), have no tokens: zeros, and '' for the groups. Special tokens' strings in texts
are ordinary text. Rows that repeat an id or are equal are documents of their own. Texts of any length are aligned
whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import bounded_batches, schemas, text_chunks, worker_cache
from terrane.llm.packing import RARE_SPACES
from terrane.session import cut

#: Pairs that are looked up by broadcast at most: those of at least so small a share of all links of documents.
LOOKUP_KEYS = 200_000
#: Ids of B are below this, so a pair of ids is one number.
PAIR = 1 << 16
#: Bytes of text that a task works on at once, and characters from which on a word is very long.
TEXT_BYTES, LONG_WORD = 1 << 20, 2000
SPACE = "▁"


def default_tokenizers() -> tuple[str, str, str]:
    """The files of A, a byte-level vocabulary, of the same as ranks, which is quicker, and of B, whose pieces add a
    space ahead of a text."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links, as the places of their tokens in A and in B, and how many tokens of A and of B lie up to each group's end.

    The cumulative ends of both sides are two sorted runs, which a stable sort merges in one pass; how many of either
    side have come by then is where its pointer stands."""
    ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
    order = np.argsort(ends, kind="stable")
    merged, is_a = ends[order], order < len(a_sizes)
    passed_a = np.cumsum(is_a)
    passed_b = np.arange(1, len(order) + 1) - passed_a
    stop = np.flatnonzero(np.append(merged[1:] != merged[:-1], True))  # each end once, at its last place
    both = np.append(False, merged[1:] == merged[:-1])[stop]
    i, j = passed_a[stop] - (both | is_a[stop]), passed_b[stop] - (both | ~is_a[stop])
    return i, j, passed_a[stop][both], passed_b[stop][both]


class Aligner:
    """The ids of both tokenizers of a text, and what their tokens are in bytes."""

    def __init__(self, files: tuple[str, str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files[0])
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        spelt = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = {i: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode() for i, token in spelt.items()}
        with open(files[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=files[2])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > PAIR:
            raise ValueError(f"{files[2]}: more than {PAIR} pieces")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, dtype=np.int64), np.array([*map(len, self.b_bytes)])
        self.a_sizes[list(self.a_bytes)] = [*map(len, self.a_bytes.values())]
        #: Each id as text, with what stands after it inside a group and at its side's end.
        spelt = lambda n, last: np.array([[f"{i}," for i in range(n)], [f"{i}{last}" for i in range(n)]], dtype=object)
        self.a_text, self.b_text = spelt(len(self.a_sizes), "|"), spelt(len(self.b_sizes), ";")

    def ids_of(self, text: str) -> list[int]:
        """A's ids. Texts with white space that the two libraries may read differently, and those with very long words,
        go to the one that reads the tokenizer's own file."""
        if any(c in text for c in RARE_SPACES) or max(map(len, text.split(" ")), default=0) > LONG_WORD:
            return self.a.encode(text, add_special_tokens=False).ids
        return self.quick(text)

    def groups(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """The groups as text: of each, its ids of A before its ids of B."""
        out = np.empty(len(a) + len(b), dtype=object)
        for ids, ends, text, others in ((a, a_ends, self.a_text, np.append(0, b_ends[:-1])), (b, b_ends, self.b_text, a_ends)):
            last = np.zeros(len(ids), dtype=np.int64)
            last[ends - 1] = 1
            out[np.arange(len(ids)) + np.repeat(others, np.diff(ends, prepend=0))] = text[last, ids]
        return "".join(out.tolist())[:-1]

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Of each text the tokens in A and in B, the groups, these as text, and the links as numbers."""
        decoded = [t.decode() for t in texts]
        for raw, text, b in zip(texts, decoded, self.b.encode(decoded, num_threads=1), strict=True):
            a, expected = self.ids_of(" " + text) if text else [], b" " + raw
            if not text or b"".join(map(self.a_bytes.__getitem__, a)) != expected or b"".join(map(self.b_bytes.__getitem__, b)) != expected:
                yield 0, 0, 0, "", np.zeros(0, dtype=np.int64)
                continue
            a, b = np.array(a), np.array(b)
            i, j, a_ends, b_ends = aligned(self.a_sizes[a], self.b_sizes[b])
            yield len(a), len(b), len(a_ends), self.groups(a, b, a_ends, b_ends), a[i] * PAIR + b[j]


def aligned_rows(files: tuple[str, str, str], keep_groups: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("aligner_of") != files:
            cache |= {"aligner_of": files, "aligner": Aligner(files)}
        row = TaskContext.get().partitionId() << 40
        for batch, texts in text_chunks(batches, size=TEXT_BYTES):
            out = []
            for n_a, n_b, n_groups, groups, links in cache["aligner"](texts):
                held, times = np.unique(links, return_counts=True)
                digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                out.append((row, n_a, n_b, n_groups, len(links), digest, held, times, groups))
                row += 1
            names = batch.column(batch.schema.get_field_index("id"))
            fields = [f for f in schema if f.name not in ("id", "groups")]
            arrays = [names, *(pa.array([o[i] for o in out], f.type) for i, f in enumerate(fields))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array([o[-1] for o in out], pa.string())] if keep_groups else []), schema=schema)

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str] | None = None, keep_groups: bool = False) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, and groups if asked for), as a written table:
    of each row the groups and the links, these as numbers a * PAIR + b with how often each occurs."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = {"id": source.schema["id"].dataType, "row": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<long>", "times": "array<int>"}
    spark_schema, arrow = schemas(columns | ({"groups": "string"} if keep_groups else {}))
    return cut(source.mapInArrow(aligned_rows(files or default_tokenizers(), keep_groups, arrow), spark_schema), "aligned").withColumnRenamed("id", id_col)


def pair_counts(alignment: DataFrame) -> DataFrame:
    """(pair, a, b, documents, most_a, most_b), as a written table: how many documents hold each id pair linked, and the
    highest such count of its A id and of its B id."""
    counts = cut(alignment.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "pairs")
    counts = counts.withColumns({"a": F.shiftright("pair", PAIR.bit_length() - 1), "b": F.col("pair").bitwiseAND(PAIR - 1)})
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("documents").alias(f"most_{side}")), side)
    return cut(counts.select("pair", "a", "b", "documents", "most_a", "most_b"), "counts")


def scored(alignment: DataFrame, counts: DataFrame, lookup_keys: int = LOOKUP_KEYS) -> DataFrame:
    """The rows with n_best, n_best_b and count_sum: the links whose pair is the most usual one of its A id (and of its B
    id), and the sum of the links' counts."""
    held = counts.select(F.col("pair").alias("key"), "documents", (F.col("documents") == F.col("most_a")).alias("best"), (F.col("documents") == F.col("most_b")).alias("best_b"))
    least = int(counts.agg(F.sum("documents")).first()[0] or 0) // lookup_keys + 1
    usual = held.where(F.col("documents") >= least)  # at most lookup_keys, as their counts add up to no more than all
    links = alignment.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    sums = [F.sum(F.when(F.col(c), F.col("times")).otherwise(0)).alias(f"n_{c}") for c in ("best", "best_b")] + [F.sum(F.col("times") * F.col("documents")).alias("count_sum")]
    met = links.join(F.broadcast(usual), F.col("pair") == F.col("key"), "left")
    near = met.where("key is not null").groupBy("row").agg(*sums)
    far = met.where("key is null").select("row", "pair", "times").join(held.where(F.col("documents") < least), F.col("pair") == F.col("key")).groupBy("row").agg(*sums)
    total = near.unionByName(far).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")])
    filled = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "n_best_b", "count_sum")]
    return alignment.drop("pairs", "times").join(total, "row", "left").select(*[c for c in alignment.columns if c not in ("row", "pairs", "times")], *filled)


def alignment_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row for each document: its id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, n_best_b and count_sum."""
    alignment = align(docs, id_col, text_col, files)
    return scored(alignment, pair_counts(alignment))
