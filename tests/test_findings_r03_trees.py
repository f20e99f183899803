"""Finding 5 of the third round: trees on sums of binned rows, priors joined once by place, sales counted once a month."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from terrane.operators import contributions, learning, ranks, timeseries
from terrane.products import price


def noisy(spark, n: int = 4000):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 20, n), rng.integers(0, 9, n), rng.integers(0, 3, n)
    y = np.where(b > 4, a, -a) / 10.0 + c + rng.normal(size=n)
    rows = [(float(i), None if j == 8 else float(j), float(k), float(v), float(w), bool(h)) for i, j, k, v, w, h in zip(a, b, c, y, 0.5 ** rng.integers(0, 4, n), rng.random(n) < 0.2, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w double, held boolean")


@pytest.mark.parametrize("weight, held", [("w", "held"), (None, None)])
def test_trees_of_binned_rows_are_those_of_all_rows(spark, monkeypatch, weight, held):
    df, fitted = noisy(spark), []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows, f=GBTRegressor.fit: fitted.append(rows.count()) or f(self, rows))
    models = []
    for least in (10**9, 0):
        monkeypatch.setattr(learning, "BINNED_ROWS", least)
        models.append(learning.fit_boosted(df, ["a", "b", "c"], "y", weight, held, trees=12, depth=4))
    both = learning.predict(models[1], learning.predict(models[0], df, "all"), "binned")
    assert len(models[0].stages[-1].trees) == len(models[1].stages[-1].trees)  # the growth stops at the same tree
    assert both.agg(F.max(F.abs(F.col("all") - F.col("binned")))).first()[0] < 1e-6
    assert fitted[-1] <= 2 * 2 * 20 * 9 * 3 and fitted[-1] < df.count()


def test_bins_of_many_values_weigh_alike(spark):
    df = spark.range(100_000).select((F.col("id") / 7).alias("x"), F.when(F.col("id") < 50_000, 3.0).otherwise(1.0).alias("w"), F.lit(2.0).alias("same"), (F.col("id") % 50).cast("double").alias("s"))
    x, same, s = learning.bin_edges(df, ["x", "same", "s"], F.col("w"))
    assert len(x) == 33 and len(same) == 3 and len(s) == 33 and s == sorted(set(s))
    total = [df.where((F.col("x") >= a) & (F.col("x") < b)).agg(F.sum("w")).first()[0] for a, b in zip(x, x[1:], strict=False)]
    assert max(total) < 1.2 * 200_000 / 32 and sum(total) == 200_000


def test_labels_that_are_missing_are_still_refused(spark, monkeypatch):
    monkeypatch.setattr(learning, "BINNED_ROWS", 0)
    with pytest.raises(Exception, match="NaN|Null"):
        learning.fit_boosted(noisy(spark).withColumn("y", F.when(F.col("a") != 3, F.col("y"))), ["a", "b"], "y", trees=2, depth=2)


def test_contributions_to_trees_of_binned_rows_add_up(spark, monkeypatch):
    monkeypatch.setattr(learning, "BINNED_ROWS", 0)
    df = noisy(spark, 1500).withColumn("a", F.col("a") + F.rand(3))
    model = learning.fit_boosted(df, ["a", "b", "c"], "y", trees=4, depth=3)
    rows = contributions.with_contributions(model, learning.predict(model, df, "fitted"), ["a", "b", "c"]).collect()
    assert all(abs(r.base_value + sum(c.value for c in r.contributions) - r.fitted) < 1e-9 for r in rows)


def test_rows_take_their_priors_by_place(spark, monkeypatch):
    places = [("flat", "x", "p", "1"), ("flat", "x", None, "1"), ("flat", "x", None, None), (None, "x", "p", "2"), ("flat", None, "q", "3")]
    rows = [(*places[i % 5], "abc"[i % 3], "all", dt.date(2020, 1, 1) + dt.timedelta(days=i), 50.0 + i % 7, 1000.0 + 13 * (i % 11)) for i in range(900)]
    sales = spark.createDataFrame(rows, "kind string, area string, project string, building string, segment string, pool string, day date, size double, price double")
    seen = []
    monkeypatch.setattr(learning, "fit_boosted", lambda df, *a, f=learning.fit_boosted: seen.append(df) or f(df, *a, trees=2, depth=2))
    cuts = {}
    monkeypatch.setattr(price, "cut", lambda df, name, f=price.cut: cuts.setdefault(name, f(df, name)))
    model = price.PricePredictor().fit(sales)
    known, (features,) = cuts["relative"].select("place.*", "segment", "y", "weight", "log_size"), seen
    assert features.count() == known.count() > 800 and "place" not in features.columns
    # each row's priors by joining all levels to the row
    direct = model._priors(known).withColumn("residual", F.col("y") - F.col("prior_building")).select("segment", "weight", *model.FEATURES, "residual")
    key = lambda r: tuple(x if isinstance(x, str) else round(x, 9) for x in r)
    assert sorted(map(key, features.select(*direct.columns).collect())) == sorted(map(key, direct.collect()))
    assert model.predict(sales.drop("price")).where("estimate is not null").count() == 900


def test_a_sale_is_counted_once_for_all_windows_of_months(spark, monkeypatch):
    rng = np.random.default_rng(6)
    odd = [float("inf"), float("-inf"), float("nan"), None, 0.0]
    rows = [("abc"[i % 3] if i % 50 else None, "all", 10 + int(rng.integers(0, 9)), odd[i // 40 % 5] if i % 40 == 0 else float(rng.integers(0, 300)) / (7 if i % 3 else 1e6)) for i in range(1500)]
    sales = spark.createDataFrame(rows, "seg string, pool string, m int, v double")
    seen = []
    monkeypatch.setattr(ranks, "union_quantiles", lambda df, *a, f=ranks.union_quantiles: seen.append(df) or f(df, *a))
    monkeypatch.setattr(ranks, "GATHERED", 5)  # parts with more values go to further rounds
    got = {(r.seg, r.month): (repr(r.value), r.source) for r in timeseries.month_index(sales, "seg", "pool", "m", "v", 10, 20, 30).collect()}
    for key in ("a", "b", "c"):
        for month in range(11, 21):
            w = next((w for w in (3, 6, 12) if sum(s == key and v is not None and month - w <= m < month for s, _, m, v in rows) >= 30), None)
            own = sorted((v for s, _, m, v in rows if s == key and v is not None and w and month - w <= m < month), key=lambda v: (v != v, v))
            if w:
                low, high = own[(len(own) - 1) // 2], own[len(own) // 2]
                value = low + (high - low) * ((len(own) - 1) * 0.5 % 1)
                assert got[key, month] == (repr(value), f"segment_{w}")
    assert got[None, 20][1] == "pooled_3"
    assert seen[0].where("__v is not null").count() <= 2 * len(rows)
