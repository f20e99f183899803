"""Filter interaction audit: what each of five filters removes, in every order of them.

Duplicates are found by a sort: rows are dealt by ranges of (text fingerprint, doc_id), so copies of one text may lie in
many ranges, and each range is sorted by fingerprint, full text and doc_id. A task reads its range once and compares
each text with its predecessor; within a run of equal texts, every row whose id is greater than the run's first id
fails filter E. A run at the range's first or last fingerprint may go on in a neighbouring range, so for these, two for
each range whatever the input, the smallest id of each text is taken over all ranges afterwards. There, texts are told
apart by the fingerprint and 64 bits of their SHA-256.

The five failures of a row are a mask of five bits. Per part, rows are counted by mask, also those of good quality and
those that are toxic; these 96 counters add up, and the figures of all orders and steps follow from them alone.

Filters: A under 200 words; B fewer than half of the words distinct; C more than 2 % of code points in `[A-Z]`; D one of
`#$%&*|`; E the text of a smaller doc_id again.

Defined results: null texts are empty, and equal to empty ones. A null doc_id is neither smaller nor greater, so its row
never fails E, makes no other fail and has no label. Rows that repeat an id are counted each; equal ids are not smaller,
so exact repeats of a row do not fail E by each other. A doc_id with several labels is good or toxic if one of them says
so; null labels and labels without a document say nothing. A null source is the part ''. An empty table gives no row.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import UPPER, bounded_batches, partitions, schemas, text_chunks
from terrane.session import cut

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
MASKS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")
#: Counters of a part: rows of each mask, those of good quality and those that are toxic.
COUNTS = ("n", "good", "toxic")


def failures(text: bytes, code_points: int) -> int:
    """The mask of the filters A to D that a text fails."""
    words = text.split()  # bytes: splits at ASCII white space alone
    upper = len(text) - len(text.translate(None, UPPER))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * code_points,
        len(text.translate(None, MARKS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def audited_rows(schema: pa.Schema):
    """(id, part, mask, print, key, edge) of a sorted range; edge marks its first and its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lowest = last = None
        mask = key = 0

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(len(schema))], schema=schema)

        for batch, texts in text_chunks(batches):
            names, parts, prints, column = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "part", "print", "text"))
            out = []
            for print_, own, size, name, part in zip(prints.to_pylist(), texts, pc.utf8_length(column).to_pylist(), names.to_pylist(), parts.to_pylist(), strict=True):
                if own != text:
                    text, mask, lowest = own, failures(own, size), None
                    key = int.from_bytes(hashlib.sha256(own).digest()[:8], "big", signed=True)
                if lowest is None:
                    lowest = name
                again = name is not None and lowest is not None and name > lowest
                if last is not None:
                    out.append(last)
                last = (name, part, mask | (DUPLICATE if again else 0), print_, key, last is None)
            yield rows(out)
        if last is not None:
            yield rows([(*last[:-1], True)])

    return run


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): the filters that each row fails."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("print", F.xxhash64("text"))
    # texts stay out of the ranges' keys, as the driver samples these
    dealt = source.repartitionByRange(partitions(spark), "print", "id").sortWithinPartitions("print", "text", "id")
    spark_schema, arrow = schemas({"id": source.schema["id"].dataType, "part": "string", "mask": "int", "print": "long", "key": "long", "edge": "boolean"})
    found = cut(dealt.mapInArrow(audited_rows(arrow), spark_schema), "masks")
    ends = found.where("edge").select("print").distinct()  # two for each task
    lowest = found.join(F.broadcast(ends), "print", "left_semi").groupBy("print", "key").agg(F.min("id").alias("lowest"))
    again = F.when(F.coalesce(F.col("id") > F.col("lowest"), F.lit(False)), DUPLICATE).otherwise(0)
    held = F.struct(F.lit(True).alias("held"), "lowest").alias("run")
    out = found.join(F.broadcast(lowest.select("print", "key", held)), ["print", "key"], "left").select("id", "part", "mask", F.col("run.held").alias("held"), F.col("run.lowest").alias("lowest"))
    mask = F.when(F.col("held"), F.col("mask").bitwiseAND(DUPLICATE - 1) + again).otherwise(F.col("mask"))
    return out.select("id", "part", mask.cast("int").alias("mask"))


def counters(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per part the 96 additive counters: arrays n, good and toxic by mask."""
    rows = found.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    cells = rows.join(said, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in COUNTS[1:]])
    held = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("cells"))

    def by_mask(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.col("cells")[m][name], F.lit(0)).cast("long"))

    return held.select("part", *[by_mask(c).alias(c) for c in COUNTS])


def steps() -> list[tuple[str, int, int, int]]:
    """Of each order and step: the order, the step from 1, the mask of the filters before it and its own bit."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), k + 1, before, bit))
            before |= bit
    return out


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def order_rows(schema: pa.Schema):
    """The figures of all orders and steps: each is a sum of a part's counters over the masks that it takes in."""
    table = steps()
    mask = np.arange(MASKS)[:, None]
    before, bit = (np.array([s[i] for s in table])[None] for i in (2, 3))
    fails, earlier = mask & bit != 0, mask & before != 0
    removed = fails & ~earlier
    takes = {"kept": mask & (before | bit) == 0, "removed": removed, "redundant": fails & earlier, "unique_fails": mask == bit}
    takes = {k: v.astype(np.int64) for k, v in takes.items()}
    letter = np.array([int(s[3]).bit_length() - 1 for s in table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                n, good, toxic = (np.array(batch.column(batch.schema.get_field_index(c))[i].as_py(), dtype=np.int64) for c in COUNTS)
                made = {k: n @ v for k, v in takes.items()} | {"good_lost": good @ takes["removed"], "toxic_lost": toxic @ takes["removed"]}
                made["shapley"] = np.bincount(letter, made["removed"], minlength=len(FILTERS)).astype(np.int64)[letter]
                arrays = [pa.array([part] * len(table), pa.string()), pa.array([s[0] for s in table]), pa.array([s[1] for s in table], pa.int32()), *(pa.array(made[f], pa.int64()) for f in FIGURES)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    counted = counters(masks(docs, id_col, text_col, part_col), labels, id_col)
    spark_schema, arrow = schemas({"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(FIGURES, "long"))
    return counted.mapInArrow(order_rows(arrow), spark_schema)
