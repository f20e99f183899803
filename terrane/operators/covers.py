"""Full-text scores by cover density: texts in which the asked words stand close together rank first.

Words are compared by their stems. Of a text that holds k of a query's m distinct stems, the minimal covers are the
shortest stretches with all k; the score is k / m times the sum of 1 / length over them. A text's score needs nothing
of other texts, so all queries are answered in one scan without a shuffle. Queries are stated, MOST_STEMS at most.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.stemming import stem
from terrane.operators.retrieval import tokens

MOST_STEMS = 10_000
#: Words whose stems a task keeps.
KEPT = 200_000


def minimal_covers(places: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """(first, last) of all stretches that hold each of k words and hold no shorter such stretch; places are (place,
    word), in order."""
    out: list[tuple[int, int]] = []
    held: dict[int, int] = defaultdict(int)
    left = 0
    for at, word in places:
        held[word] += 1
        while held[places[left][1]] > 1:
            held[places[left][1]] -= 1
            left += 1
        if len(held) == k:
            first = places[left][0]
            if not out or first > out[-1][0]:
                out.append((first, at))
    return out


def scored_rows(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_stem, sizes = shared.value
        stems: dict[str, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                places, words = defaultdict(list), held.as_py()  # the words of one text at a time
                for i, word in enumerate(words or ()):
                    asked = stems.get(word)
                    if asked is None:
                        if len(stems) > KEPT:
                            stems.clear()
                        asked = stems[word] = by_stem.get(stem(word), ())
                    for query, number in asked:
                        places[query].append((i, number))
                for query, own in places.items():
                    k = len({number for _, number in own})
                    out.append((query, doc, k, k / sizes[query] * sum(1 / (b - a + 1) for a, b in minimal_covers(own, k))))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], batch.schema.field(0).type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())], names=names)

    return run


def cover_scores(docs: DataFrame, queries: DataFrame, doc: str, text: str) -> DataFrame:
    """(query, doc, stems, score) of all texts that hold a word of a query; queries has query (a whole number) and
    term. Null texts and terms hold nothing; terms that share a stem are one."""
    held = queries.where(F.col("query").isNotNull() & F.col("term").isNotNull()).select(F.col("query").cast("long").alias("query"), F.explode(tokens(F.col("term"))).alias("term")).distinct().limit(MOST_STEMS + 1).collect()
    if len(held) > MOST_STEMS:
        raise ValueError(f"more than {MOST_STEMS} asked words")
    by_query: dict[int, list[str]] = defaultdict(list)
    for query, word in sorted({(r.query, stem(r.term)) for r in held}):
        by_query[query].append(word)
    by_stem: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for query, words in by_query.items():
        for number, word in enumerate(words):
            by_stem[word].append((query, number))
    shared = docs.sparkSession.sparkContext.broadcast(({w: tuple(v) for w, v in by_stem.items()}, {q: len(w) for q, w in by_query.items()}))
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("words"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(scored_rows(shared, ["query", "doc", "stems", "score"]), f"query long, doc {kind}, stems int, score double")
