"""Faults of the third round's findings that show with the size of the input, each on a small table."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.operators import bags, covers, phrases, timeseries
from terrane.plans import QUERIES, SQL
from terrane.products import queries


def test_parsed_queries_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_QUERIES", 10)
    asked = spark.createDataFrame([(i, f"{i % 5 + 1} bed villa under {i + 900}k") for i in range(40)], "id int, text string").coalesce(1)
    rows = queries.parsed(asked).select("id", "slots.bedrooms", "slots.max_price", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in rows}) == 4
    assert sorted((r.id, r.bedrooms, r.max_price) for r in rows) == [(i, i % 5 + 1, (i + 900) * 1e3) for i in range(40)]


def batch_of_texts(n: int, words: int) -> pa.RecordBatch:
    flat = pa.array([f"word{i % 997}" for i in range(n * words)])
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), flat)], names=["doc", "words"])


def traced(run) -> tuple[object, float]:
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


@pytest.mark.parametrize("kind", ["covers", "phrases"])
def test_words_of_few_texts_are_objects_at_once(kind):
    batch = batch_of_texts(1000, 500)
    if kind == "covers":
        run = covers.scored_rows(SimpleNamespace(value=({"word5": ((1, 0),)}, {1: 1})), ["query", "doc", "stems", "score"])
    else:
        schema = pa.schema([*batch.schema, pa.field("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("phrase", pa.int32())])))])
        run = phrases.phrase_rows(SimpleNamespace(value=phrases.Automaton([["word5"]])), 1, schema)
    rows, peak = traced(lambda: [b for b in run(iter([batch]))])
    assert peak < 8e6  # the words of all 1,000 texts are about 30 MB as objects
    expected = sum(any(w % 997 == 5 for w in range(i * 500, i * 500 + 500)) for i in range(1000))
    hits = sum(b.num_rows for b in rows) if kind == "covers" else sum(bool(f) for b in rows for f in b.column(2).to_pylist())
    assert hits == expected and (kind == "covers" or sum(b.num_rows for b in rows) == 1000)


def test_a_word_of_a_bag_is_hashed_once_in_a_task(spark, tmp_path, monkeypatch):
    hashed = []
    monkeypatch.setattr(bags, "slot_of", lambda word, slots, own=bags.slot_of: hashed.append(word) or own(word, slots))
    monkeypatch.setattr(bags, "ROWS", 7)
    monkeypatch.setattr(bags, "BYTES", 9000)
    whole = batch_of_texts(100, 500)
    batch = pa.RecordBatch.from_arrays([whole.column(0), pa.array([" ".join(words) for words in whole.column(1).to_pylist()])], names=["doc", "text"])
    out = list(bags.bag_rows(384, ["doc", "slots", "counts"])(iter([batch, batch.slice(3, 5)])))
    assert len(hashed) == 997 and sum(b.num_rows for b in out) == 105
    assert all(sum(counts) == 500 for b in out for counts in b.column(2).to_pylist())
    # rows that share an id are one text, that of null too; null and empty texts hold nothing
    texts = [(1, "One two two"), (1, "two three"), (2, None), (3, ""), (4, "Ünd über x1"), (None, "one a"), (None, "a"), (5, "?!")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = duckdb.connect().execute(SQL["fn15_hashed_bag_of_words"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = QUERIES["fn15_hashed_bag_of_words"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr) and any(r.doc_id is None for r in got)


def test_intervals_are_looked_up_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "TASK_ROWS", 100)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, int(k) if i % 50 else None, int(d)) for i, (k, d) in enumerate(zip(rng.integers(0, 60, 500), rng.integers(0, 900, 500)))], "id long, k long, at long")
    given = spark.createDataFrame([(int(k), int(a), int(a + w), "xyz"[i % 3]) for i, (k, a, w) in enumerate(zip(rng.integers(0, 60, 700), rng.integers(0, 900, 700), rng.integers(0, 300, 700)))], "k long, a long, b long, kind string")
    out = timeseries.interval_features(rows, given, "k", "at", "a", "b", "kind").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in out}) == 12 > 4 and len(out) == 500
    held = [tuple(g) for g in given.collect()]
    for r in out:
        ours = [g for g in held if g[0] == r.k]
        opened = [g for g in ours if g[1] <= r.at < g[2]]
        assert (r.n_open, r.n_kinds, r.days_to_next) == (len(opened), len({g[3] for g in opened}), min((g[2] - r.at for g in opened), default=None))
        assert r.n_ended == sum(r.at - 730 < g[2] <= r.at for g in ours)


def test_rolling_frames_of_grouped_keys_are_those_of_windows(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "GROUP_ROWS", 150)
    monkeypatch.setattr(timeseries, "SORTED", 64)
    rng = np.random.default_rng(9)
    odd = {3: None, 11: float("nan"), 19: float("inf"), 23: -float("inf")}
    rows = [(i, f"k{i % 13}" if i % 17 else None, i % 2 if i % 29 else None, int(rng.integers(-40, 400)) if i % 10 else None, odd.get(i % 31, float(rng.integers(0, 50)))) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, a string, b int, day int, v double")
    keys, frames, counts = ["a", "b"], {"now": (-30, -1), "ahead": (5, 40), "wide": (-200, 200)}, {"year": (-365, -1)}
    got = timeseries.rolling_stats(df, keys, "day", "v", frames, counts)
    known, expected = F.col("a").isNotNull() & F.col("b").isNotNull(), df
    for name, (low, high) in (frames | counts).items():
        median, n = timeseries.rolling("v", timeseries.day_frame(keys, "day", low, high))
        expected = expected.withColumns(({f"{name}_median": F.when(known, median)} if name in frames else {}) | {f"{name}_n": F.when(known, n).otherwise(F.lit(0))})
    assert got.columns == expected.columns and [t for _, t in got.dtypes] == [t for _, t in expected.dtypes]
    gap = [(g, e) for g, e in zip(sorted(map(repr, got.collect())), sorted(map(repr, expected.collect())), strict=True) if g != e]
    assert not gap, (len(gap), gap[:3])
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # which goes through each frame for each row
    assert timeseries.rolling_stats(df.limit(0), keys, "day", "v", frames, counts).count() == 0
