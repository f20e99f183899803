"""Finding 1 of the fourth round: fits share their jobs, an area's frames are worked out once for each day."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from terrane.operators import boosting, contributions, learning, timeseries
from terrane.products import forecast


def noisy(spark, n: int = 3000):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 20, n), rng.integers(0, 9, n), rng.integers(0, 3, n)
    y = np.where(b > 4, a, -a) / 10.0 + c + rng.normal(size=n)
    rows = [(float(i), None if j == 8 else float(j), float(k), float(v), None if i == 3 else float(v * v), int(d)) for i, j, k, v, d in zip(a, b, c, y, rng.integers(0, 100, n), strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, z double, day int")


def test_trees_fitted_together_are_those_fitted_alone(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 700)
    df, features = noisy(spark), ["a", "b", "c"]
    fits = {"all": ("y", None), "early": ("y", 60), "other": ("z", None), "none": ("z", -5)}
    models = boosting.fit_together(df, features, "day", fits, trees=6, depth=3)
    assert set(models) == {"all", "early", "other"}
    for name, (label, before) in list(fits.items())[:3]:
        own = df.where(F.col(label).isNotNull() & (F.col("day") < (1000 if before is None else before)))
        alone = learning.fit_boosted(own, features, label, trees=6, depth=3)
        both = learning.predict(models[name], learning.predict(alone, df, "alone"), "together")
        assert both.agg(F.max(F.abs(F.col("alone") - F.col("together")))).first()[0] < 1e-6
        rows = contributions.with_contributions(models[name], learning.predict(models[name], own, "fitted"), features).limit(200).collect()
        assert all(abs(r.base_value + sum(c.value for c in r.contributions) - r.fitted) < 1e-9 for r in rows)
    with pytest.raises(Exception, match="NaN"):
        boosting.fit_together(df.withColumn("y", F.lit(float("nan"))), features, "day", {"all": ("y", None)})


def test_medians_by_parts_are_those_of_the_values():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.random(3000), np.repeat([0.25, np.inf, -np.inf], 40)])
    rng.shuffle(v)
    first = rng.integers(0, 3000, 300)
    last = np.maximum(first, np.minimum(len(v), first + rng.integers(0, 900, 300)))
    with np.errstate(invalid="ignore"):
        expected = [np.median(v[a:b]) if b > a else np.nan for a, b in zip(first, last, strict=True)]
    np.testing.assert_allclose(timeseries.window_medians(v, first, last), expected, rtol=1e-15)


@pytest.mark.parametrize("hot, whole", [(10**6, 10**6), (100, 10**6), (100, 150)])
def test_days_since_and_asked_rows_by_size_of_key(spark, monkeypatch, hot, whole):
    rng = np.random.default_rng(7)
    rows = [(i, ["big", "mid", "small", None][int(rng.choice(4, p=[0.6, 0.25, 0.1, 0.05]))], int(rng.integers(0, 900)) if i % 40 else None, float(rng.integers(0, 50)) if i % 9 else None, i % 7 == 0) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, day int, v double, asked boolean")
    frames, counts = {"base": (-92, -1), "lag": (-183, -92), "ahead": (76, 107)}, {"year": (-365, -1)}
    expected = timeseries.rolling_stats(df, ["k"], "day", "v", frames, counts).withColumn("since", timeseries.days_since_previous(["k"], "day"))
    expected = {r.id: r for r in expected.collect()}
    monkeypatch.setattr(timeseries, "HOT_ROWS", hot)
    monkeypatch.setattr(timeseries, "BLOCK_ROWS", whole)
    got = timeseries.rolling_stats(df, ["k"], "day", "v", frames, counts, "since").collect()
    assert {r.id: r for r in got} == expected and len(got) == len(rows)
    asked = timeseries.rolling_stats(df, ["k"], "day", "v", frames, counts, "since", "asked").collect()
    assert {r.id: r for r in asked} == {i: r for i, r in expected.items() if r.asked} and len(asked) == 100
    daily = timeseries.daily_stats(df, ["k"], "day", "v", frames, counts, "since", "asked").collect()
    by_day = {(r.k, r.day, *r[5:]) for r in expected.values() if r.asked}
    assert {tuple(r) for r in daily} == by_day and len(daily) == len(by_day)


def test_forecasts_need_no_fit_of_their_own_for_each_fold(spark, monkeypatch):
    rng = np.random.default_rng(8)
    start, n = dt.date(2015, 1, 1), 3000
    sales = [("x", f"b{i % 3}", "flat", start + dt.timedelta(days=int(d)), 50.0, 50.0 * (1000 + d / 2 + 100 * np.sin(d / 200) + rng.normal())) for i, d in enumerate(rng.integers(0, 2500, n))]
    sales = spark.createDataFrame([(*s[:5], float(s[5])) for s in sales], "area string, building string, kind string, date date, size double, price double")
    alone = []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: alone.append(rows))
    model = forecast.Forecaster().fit(sales)
    out = model.forecast(sales).collect()
    assert not alone and len(out) == 3 and model.models
    # what the requests see of their history is what they see of all sales
    asked = sales.select("area", "building", "kind").distinct().withColumns({"date": F.lit(sales.agg(F.date_add(F.max("date"), 1)).first()[0]), "asked": F.lit(True)})
    whole = forecast.dataset(sales.unionByName(asked, allowMissingColumns=True)).where("asked")
    assert {(r.building, r.level, r.base) for r in whole.collect()} == {(r.building, r.level, r.base) for r in out}
