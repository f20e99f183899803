"""Faults of the third round's findings, each on a small table that shows it."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import learning, ranks, rules
from terrane.plans import QUERIES, SQL


def lines(spark, folder, odd: str | None = None, n: int = 1500) -> None:
    rng = np.random.default_rng(4)
    rows = [(i // 3 % 400, i % 30, i % 7, i % 3 + 1, float(i % 50 + 1), float(rng.uniform(900, 90_000)), i % 11 / 100, 0.02, "RAN"[i % 3], "OF"[i % 2], dt.datetime(1996, 1, 1) + dt.timedelta(days=i * 37 % 1300)) for i in range(n)]
    rows += [(5000 + i, 1, i % 7, 1, 10.0, 20_000.0 * (1 + 9 * (i % 20 == 0)), 0.05, 0.0, odd if i % 2 else "R", "O", dt.datetime(1997, 5, 1)) for i in range(100)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "lineitem.parquet"))


def against_sql(spark, folder, name: str) -> list[tuple]:
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).collect()), key=repr)
    assert got == sorted(con.execute(SQL[name]).fetchall(), key=repr)
    return got


def test_sessions_a_whole_gap_apart_are_two(spark, tmp_path):
    at = dt.datetime(2024, 1, 30, 3, 45, 35)
    times = [at, at + dt.timedelta(hours=6), at + dt.timedelta(hours=12, seconds=-1), at + dt.timedelta(hours=18, seconds=-1, microseconds=900_000)]
    rows = [(i, t, 805) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert [r[2] for r in against_sql(spark, tmp_path, "st_session_windows")] == [1, 2, 1]


def _groups() -> dict:
    rng = np.random.default_rng(1)
    return {"even": rng.uniform(-5, 5, 4000), "ties": rng.integers(0, 3, 300).astype(float), "tail": np.exp(rng.normal(0, 2, 300)), "same": np.full(200, 2.5), None: np.arange(100.0)}


def _check_ranks(spark, groups: dict) -> None:
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, v double")
    picks = {"first": F.lit(0), "mid": F.floor((F.col("n") - 1) / 2), "third": F.floor(F.col("n") / 3), "last": F.col("n") - 1, "beyond": F.col("n"), "none": F.lit(None).cast("int")}
    got = {r.g: r for r in ranks.at_ranks(df, ["g"], "v", picks).collect()}
    assert len(got) == len(groups)
    for g, values in groups.items():
        values, n, r = np.sort(values), len(values), got[g]
        assert r.n == n and r.beyond is None and r.none is None
        np.testing.assert_array_equal([r.first, r.mid, r.third, r.last], values[[0, (n - 1) // 2, n // 3, n - 1]])


def test_ranks_of_large_groups_come_from_counts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "GATHERED", 60)
    monkeypatch.setattr(ranks, "BINS", 16)  # several rounds
    monkeypatch.setattr(ranks, "ranked", lambda *a, **b: pytest.fail("a range sort of all rows"))
    _check_ranks(spark, _groups())


def test_values_that_bins_cannot_part_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(ranks, "GATHERED", 3)
    monkeypatch.setattr(ranks, "BINS", 4)
    monkeypatch.setattr(ranks, "ROUNDS", 2)
    odd = [-np.inf, np.nan, np.inf, -1.0, 0.0, 1e308, -1e308, 5e-324, 1e-300, 1e-9, 2.0, 3.0]
    _check_ranks(spark, {"odd": np.array(odd * 5), "even": np.arange(200.0), "few": np.array([2.0, 1.0])})


def test_medians_of_segments_deal_no_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "GATHERED", 50)
    made = []
    monkeypatch.setattr(ranks, "counted", lambda *a, f=ranks.counted: made.append(1) or f(*a))
    rows = [(float(i % 50 + 1), 900.0 + i * 7 % 5000, i % 11 / 100, "RAN"[i % 3]) for i in range(500)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert len(against_sql(spark, tmp_path, "ag21_overlapping_segments")) == 4 and made


def test_month_medians_need_no_range_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "GATHERED", 20)
    monkeypatch.setattr(ranks, "ranked", lambda *a, **b: pytest.fail("a range sort of all rows"))
    lines(spark, tmp_path, "A")
    assert {r[3] for r in against_sql(spark, tmp_path, "wn12_month_index")} >= {"segment_3", "pooled_3"}


@pytest.mark.parametrize("name", ["an1_tiered_outliers", "an1_classify_reason_counts", "wn3_unit_retest"])
def test_narrow_tiers_share_one_shuffle(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(rules, "NARROW_GROUPS", 20)
    monkeypatch.setattr(rules, "MIN_PEERS", 30)
    asked = []
    monkeypatch.setattr(ranks, "quantiles", lambda df, *a, f=ranks.quantiles: asked.append({r.tier for r in df.select("tier").distinct().collect()}) or f(df, *a))
    lines(spark, tmp_path)
    against_sql(spark, tmp_path, name)
    assert asked and all(1 not in tiers and 2 not in tiers for tiers in asked)


def test_training_tasks_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(learning, "TASK_ROWS", 50)
    seen = []
    monkeypatch.setattr(learning.Pipeline, "fit", lambda self, df, f=learning.Pipeline.fit: seen.append(df.rdd.getNumPartitions()) or f(self, df))
    df = spark.range(1000).coalesce(1).select((F.col("id") % 7).cast("double").alias("size"), (F.col("id") % 7 * 2.0).alias("y"), (F.col("id") % 5 == 0).alias("check"), F.lit("other").alias("other"))
    model = learning.fit_boosted(df, ["size"], "y", validation="check", trees=2, depth=3, step=1.0)
    assert seen == [20]
    assert all(abs(r.fitted - r.y) < 0.5 for r in learning.predict(model, df, "fitted").collect())
