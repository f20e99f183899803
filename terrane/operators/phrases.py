"""Phrases of a dictionary in lists of words: all of them in one walk, then the leftmost longest that do not overlap.

The dictionary becomes a trie of words with failure links, so a row costs its words and its matches, however many
phrases there are and however long these are. It is a dimension: it is built on the driver up to MOST phrases, more are
an error, and goes to each executor once. Rows stay where they are; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that a dictionary may hold.
MOST = 1_000_000
FOUND = "array<struct<start:int,end:int,phrase:int>>"


class Automaton:
    """Nodes are numbers; `length` is of the phrase that ends at a node, `phrase` its number, `next` the nearest node on
    the chain of failure links where a phrase ends."""

    def __init__(self, phrases: list[list[str]]):
        self.step: list[dict[str, int]] = [{}]
        self.fail, self.next, self.length, self.phrase = [0], [0], [0], [-1]
        for number, words in enumerate(phrases):
            node = 0
            for word in words:
                node = self.step[node].setdefault(word, len(self.step))
                if node == len(self.step):
                    self.step.append({})
                    for values, value in ((self.fail, 0), (self.next, 0), (self.length, 0), (self.phrase, -1)):
                        values.append(value)
            if node and not self.length[node]:
                self.length[node], self.phrase[node] = len(words), number
        level = list(self.step[0].values())
        while level:
            below = []
            for node in level:
                for word, child in self.step[node].items():
                    at = self.fail[node]
                    while at and word not in self.step[at]:
                        at = self.fail[at]
                    self.fail[child] = at = self.step[at].get(word, 0)
                    self.next[child] = at if self.length[at] else self.next[at]
                    below.append(child)
            level = below

    def every(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start, end, phrase) of all occurrences, by end."""
        node = 0
        for i, word in enumerate(words):
            while node and word not in self.step[node]:
                node = self.fail[node]
            node = self.step[node].get(word, 0)
            at = node if self.length[node] else self.next[node]
            while at:
                yield i + 1 - self.length[at], i + 1, self.phrase[at]
                at = self.next[at]

    def longest(self, words: list[str]) -> list[tuple[int, int, int]]:
        """From left to right, at each place that is free the longest phrase that starts there."""
        kept, free = [], 0
        for start, end, phrase in sorted(self.every(words), key=lambda m: (m[0], -m[1])):
            if start >= free:
                kept.append((start, end, phrase))
                free = end
        return kept


#: Rows of a batch whose words a task turns into objects at once.
SLICE = 64


def phrase_rows(automaton, words_index: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = automaton.value.longest
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            found = [[{"start": a, "end": b, "phrase": p} for a, b, p in longest(words)] if words else [] for words in batch.column(words_index).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, schema.field(len(schema) - 1).type)], schema=schema)

    return run


def with_phrases(rows: DataFrame, words: str, dictionary: DataFrame, phrase: str, name: str = "found") -> tuple[DataFrame, DataFrame]:
    """(rows, phrases): the rows with `name`, the leftmost longest phrases in their list of words as (start, end, phrase),
    places in words; and the dictionary with `number`, which `phrase` of a match refers to. Phrases are texts of words
    with single spaces; null and empty ones are in no row, and of equal ones the first by all columns counts. Null
    lists hold nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    known = dictionary.where(F.coalesce(F.col(phrase), F.lit("")) != "")
    order = [phrase, *(c for c in known.columns if c != phrase)]
    held = known.orderBy(*[F.col(c) for c in order]).limit(MOST + 1).collect()
    if len(held) > MOST:
        raise ValueError(f"a dictionary of more than {MOST} phrases")
    automaton = spark.sparkContext.broadcast(Automaton([r[phrase].split() for r in held]))
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(held)], known.schema.fromJson({"type": "struct", "fields": [{"name": "number", "type": "integer", "nullable": False, "metadata": {}}, *known.schema.jsonValue()["fields"]]}))
    schema = rows.withColumn(name, F.lit(None).cast(FOUND)).schema
    return rows.mapInArrow(phrase_rows(automaton, rows.columns.index(words), to_arrow_schema(schema)), schema), numbered
