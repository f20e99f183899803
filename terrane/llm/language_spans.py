"""Language identification with spans of mixed-language text.

A word is a run of letters with their marks. The script of its first letter narrows its candidates to the languages
that use that script; a script that no language uses leaves all of them. A candidate's score of a word is the sum of
log probabilities of its byte n-grams (1 to 4 bytes, the spaces around the word included, lower case) under smoothed
counts, less their mean over all languages, divided by the longest n-gram's length, as n-grams overlap. Viterbi then finds the best sequence of languages of a
text, where each change from one word to the next costs `SWITCH`: runs of one language are its spans. The language of
the text is the one with most letters in its spans, and its score is the share of these letters times that language's
probability over the words of its spans, by the same word scores.

N-gram counts come from documents with a language whose crc32(id) mod 4 is not 2: of each language all, or of a frequent
one those of about FIT_ROWS whose hash of id and text is lowest, so rare languages are fitted on whole. The LANGUAGES most frequent
languages are learned. Everything else reads all rows. Language, source and id are no input of a prediction.

Defined results: null texts and texts without a letter are `und` with score 0, and have no span; so are all texts when
nothing can be learned. Null languages are not learned from. Rows that repeat an id or are equal are predicted each.
Ties go to the more frequent language, then to the name that sorts first. Texts of any length are read whole. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import bounded_batches, mix, schemas, text_chunks
from terrane.llm.toxic_crf import held_out
from terrane.session import cut

UNKNOWN = "und"
#: Rows of a language that are fitted on, about, and languages that are learned at most.
FIT_ROWS, LANGUAGES = 4000, 256
#: Longest n-gram in bytes, cells that n-grams are hashed into, and what is added to each cell's count.
LONGEST, CELLS, SMOOTHING = 4, 1 << 16, 0.05
#: Bytes of words that are scored at once, and of text that a task works on at once with up to eight languages.
BLOCK_BYTES, TEXT_BYTES = 1 << 19, 2 << 20
#: Cost of a change of language, in nats; and what a script of another language costs.
SWITCH, FOREIGN = 8.0, 1e6
#: Share of a language's words from which on it uses a script.
SCRIPT_SHARE = 0.01
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LAST_WORD = regex.compile(r"(?r)\p{L}[\p{L}\p{M}]*")
#: First code points of ranges of scripts, and the script of each range ("" where letters of several lie).
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPTS = sorted({name for _, name in RANGES})
STARTS = np.array([start for start, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in RANGES])
SPACE = 32


@dataclass
class Words:
    """The words of some texts: of each its script, its letters and its place in the normalised bytes, and how many each
    text has."""

    script: np.ndarray
    letters: np.ndarray
    data: np.ndarray  # every word with a space ahead, and a last space
    first: np.ndarray
    counts: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    found = [WORD.findall(t.decode()) for t in texts]
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = [w for own in found for w in own]
    letters = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    heads = np.fromiter((ord(w[0]) for w in flat), dtype=np.int64, count=len(flat))
    data = np.frombuffer((" " + " ".join(flat).lower() + " ").encode() if flat else b"", dtype=np.uint8)
    return Words(SCRIPT_OF[np.searchsorted(STARTS, heads, "right") - 1], letters, data, np.flatnonzero(data == SPACE)[:-1], counts)


def cells_of(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each n-gram length, for words with a space ahead of each and one at the end: the places where n-grams begin, and
    their cells. The space after a word may end an n-gram; a lone space is none."""
    n = len(data)
    spaces = np.flatnonzero(data == SPACE)
    if len(spaces) < 2:
        return
    until = spaces[np.minimum(np.searchsorted(spaces, np.arange(n), "right"), len(spaces) - 1)]
    h = np.zeros(n, dtype=np.uint64)
    for size in range(1, LONGEST + 1):
        h = h[: n - size + 1] * np.uint64(257) + data[size - 1 :] + np.uint64(1)
        whole = np.arange(len(h)) + (size - 1) <= until[: len(h)]
        at = np.flatnonzero(whole & (data[: len(h)] != SPACE) if size == 1 else whole)
        yield at, (mix(h[at] + np.uint64(size << 48)) % np.uint64(CELLS)).astype(np.int64)


@dataclass
class Model:
    """Scores of the cells, which languages use which script, and log shares of the languages, most frequent first."""

    names: list[str]
    weights: np.ndarray  # languages x CELLS
    uses: np.ndarray  # scripts x languages
    prior: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages."""
        n = len(words.first)
        out = np.empty((n, len(self.names)), dtype=np.float32)
        edges = np.unique(np.append(np.searchsorted(words.first, np.arange(0, len(words.data), BLOCK_BYTES)), n))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            start = words.first[a]
            stop = words.first[b] if b < n else len(words.data) - 1
            owner = np.repeat(np.arange(b - a), np.diff(np.append(words.first[a:b], stop)))
            found = [(owner[at], cells) for at, cells in cells_of(words.data[start : stop + 1])]
            owner, cells = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            for i, weights in enumerate(self.weights):
                out[a:b, i] = np.bincount(owner, weights[cells], minlength=b - a)
        own = self.uses[words.script]
        return out - np.where(own | ~own.any(axis=1, keepdims=True), np.float32(0), np.float32(FOREIGN))


def viterbi(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word, of all texts at once: step t is taken for every text that has more than t words."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    open_at = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    came = np.zeros(scores.shape, dtype=np.int16)
    stay = np.arange(scores.shape[1], dtype=np.int16)
    best = np.zeros((len(counts), scores.shape[1]))
    if longest:
        best[: open_at[0]] = prior + scores[first[: open_at[0]]]
    for t in range(1, longest):
        n = open_at[t]
        at, own = first[:n] + t, best[:n]
        top = own.argmax(axis=1)
        moved = own[np.arange(n), top][:, None] - switch
        change = moved > own
        came[at] = np.where(change, top[:, None], stay)
        best[:n] = np.where(change, moved, own) + scores[at]
    out = np.zeros(len(scores), dtype=np.int64)
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = open_at[t]
        at = first[:n] + t
        out[at] = state[:n]
        state[:n] = came[at, state[:n]]  # texts that end before t keep the state of their own end
    return out


def counted_rows(names: list[str]):
    """Of each task's texts: how often each cell and script occurs in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, scripts = np.zeros((len(names), CELLS), dtype=np.int64), np.zeros((len(names), len(SCRIPTS)), dtype=np.int64)
        number = {name: i for i, name in enumerate(names)}
        for batch, texts in text_chunks(batches):
            lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for i in set(lang):
                words = words_of([t for t, x in zip(texts, lang, strict=True) if x == i])
                for _, own in cells_of(words.data):
                    cells[number[i]] += np.bincount(own, minlength=CELLS)
                scripts[number[i]] += np.bincount(words.script, minlength=len(SCRIPTS))
        both = np.concatenate([cells, scripts], axis=1)
        for i, name in enumerate(names):
            held = np.flatnonzero(both[i])
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held, pa.int32()), pa.array(both[i][held], pa.int64())], names=["lang", "cell", "n"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model | None:
    """A model of documents with a language that are not held out, the same ones on every run; None if there are none.
    The driver gets counts: of each language its rows, and of each language and cell one number."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    names, total = [r.lang for r in sizes], [r["count"] for r in sizes]
    kept = docs.sparkSession.createDataFrame([(r.lang, min(1.0, rows / r["count"])) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(kept), "lang").where(place < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(counted_rows(names), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), CELLS + len(SCRIPTS)))
    number = {name: i for i, name in enumerate(names)}
    who = np.array([number[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)
    counts[who, counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    cells = counts[:, :CELLS] + SMOOTHING
    log = np.log(cells / cells.sum(axis=1, keepdims=True))
    scripts = counts[:, CELLS:]
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    uses &= scripts > 0
    return Model(names, (log - log.mean(axis=0)) / LONGEST, np.ascontiguousarray(uses.T), np.log(np.array(total) / sum(total)))


def predicted_rows(model: Model | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, size=TEXT_BYTES * 8 // max(8, len(model.names) if model else 0)):
            n = len(texts)
            lang, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            words = words_of(texts)
            if model is not None and len(words.first):
                scores = model.scores(words)
                path = viterbi(scores, words.counts, model.prior)
                size, owner = len(model.names), np.repeat(np.arange(n), words.counts)
                letters = np.bincount(owner * size + path, words.letters, minlength=n * size).reshape(n, size)
                chosen = letters.argmax(axis=1)
                # log odds of the chosen language over the words of its spans
                own = path == chosen[owner]
                total = np.stack([np.bincount(owner[own], scores[own, i], minlength=n) for i in range(size)], axis=1) + model.prior
                odds = np.exp(np.clip(total - total[np.arange(n), chosen][:, None], -700, 700))
                some = words.counts > 0
                score[some] = (letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1) / odds.sum(axis=1))[some]
                last = np.cumsum(words.counts)
                turns = np.flatnonzero(np.diff(path) != 0) + 1
                for d in np.flatnonzero(some).tolist():
                    lang[d] = model.names[chosen[d]]
                    start, stop = last[d] - words.counts[d], last[d]
                    runs = [start, *turns[(turns > start) & (turns < stop)].tolist(), stop] if len(turns) else [start, stop]
                    text = texts[d].decode()
                    if len(runs) == 2:
                        spans[d] = [{"start": WORD.search(text).start(), "end": LAST_WORD.search(text).end(), "lang": model.names[path[start]]}]
                    else:
                        places = [m.span() for m in WORD.finditer(text)]
                        spans[d] = [{"start": places[a - start][0], "end": places[b - start - 1][1], "lang": model.names[path[a]]} for a, b in zip(runs, runs[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans): spans of one language, in code points, from its first word's start to its last's end."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark_schema, arrow = schemas({"id": source.schema["id"].dataType, "lang_pred": "string", "score": "double", "spans": "array<struct<start:long,end:long,lang:string>>"})
    return source.mapInArrow(predicted_rows(model, arrow), spark_schema).withColumnRenamed("id", id_col)
