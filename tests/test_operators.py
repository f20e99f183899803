"""Hand-computed cases of the operators."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import drift, estimates, folds, pairs, ranks, retrieval, rules
from terrane.operators import timeseries as ts
from terrane.operators.graph import connected_components


def test_first_match_takes_the_first_true_rule(spark):
    df = spark.createDataFrame([(1, None), (5, 1), (None, 1)], "a int, b int")
    got = df.select(rules.first_match([("small", F.col("a") < 3), ("flag", F.col("b") == 1)]).alias("r")).collect()
    assert [r.r for r in got] == ["small", "flag", "flag"]


def test_repeats_count_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, at int")
    got = {r.at: r.d for r in df.select("at", rules.is_repeat(["k"], ["at"]).alias("d")).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_tiers_fall_back_when_peers_are_few_or_flat(spark):
    rows = [("a", "x", float(i)) for i in range(5)] + [("a", "y", 7.0), ("b", "z", 1.0), ("b", "z", 1.0), ("b", "z", 1.0)]
    out = rules.tiered_robust_z(spark.createDataFrame(rows, "g string, s string, v double"), "v", [["g", "s"], ["g"], []][:2], 3).collect()
    tiers = {(r.g, r.s): r.peer_tier for r in out}
    assert tiers == {("a", "x"): 1, ("a", "y"): 2, ("b", "z"): None}
    x = next(r for r in out if r.s == "x" and r.v == 4.0)
    assert x.robust_z == pytest.approx((4.0 - 2.0) / max(1.4826 * 1.0, 0.12))


def test_window_edges(spark):
    days = [-93, -92, -1, 0, 75, 76, 107, 108]
    df = spark.createDataFrame([("k", d, float(d)) for d in days] + [(None, 0, 1.0)], "k string, day int, v double")
    out = ts.rolling_stats(df, ["k"], "day", "v", {"base": (-92, -1), "ahead": (76, 107)})
    row = out.where("k = 'k' and day = 0").first()
    assert (row.base_n, row.ahead_n) == (2, 2)
    assert row.base_median == pytest.approx(-46.5) and row.ahead_median == pytest.approx(91.5)
    null = out.where("k is null").first()
    assert null.base_n == 0 and null.base_median is None


def test_hot_keys_by_blocks_equal_windows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, int(d), None if v > 38 else float(v), i) for i, (k, d, v) in enumerate(zip(rng.choice(["hot", "warm", "cold", None], 900, p=[0.6, 0.25, 0.1, 0.05]), rng.integers(-40, 900, 900), rng.integers(0, 40, 900)))]
    rows += [("hot", None, 1.0, 9000), ("hot", None, 2.0, 9001)]
    df = spark.createDataFrame([(None if k is None else str(k), *r) for k, *r in rows], "k string, day int, v double, i int")
    frames, counts = {"base": (-92, -1), "ahead": (76, 107), "same": (0, 0)}, {"year": (-365, -1)}
    whole = {r.i: tuple(r) for r in ts.rolling_stats(df, ["k"], "day", "v", frames, counts).collect()}
    monkeypatch.setattr(ts, "HOT_ROWS", 100)
    split = ts.rolling_stats(df, ["k"], "day", "v", frames, counts)
    assert {r.i: tuple(r) for r in split.collect()} == whole and len(whole) == len(rows)


def test_intervals_of_hot_keys_by_year(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, k, int(d)) for i, (k, d) in enumerate(zip(rng.choice(["hot", "cold", "none"], 300), rng.integers(0, 3000, 300)))] + [(900, None, 5), (901, "hot", None)]
    given = [(k, int(s), int(s + n), t) for k, s, n, t in zip(rng.choice(["hot", "cold"], 200, p=[0.8, 0.2]), rng.integers(-500, 3000, 200), rng.integers(-20, 1500, 200), rng.choice(["rail", "road", "port"], 200))]
    given += [("hot", None, 5, "rail"), ("hot", 7, None, "rail"), (None, 1, 2, "road"), ("cold", 100, 2900, None)]
    df = spark.createDataFrame([(i, None if k is None else str(k), d) for i, k, d in rows], "i int, key string, at int")
    intervals = spark.createDataFrame([(None if k is None else str(k), s, e, None if t is None else str(t)) for k, s, e, t in given], "key string, s int, e int, kind string")

    def by_hand(key, at):
        own = [(s, e, t) for k, s, e, t in given if k is not None and k == key and s is not None and e is not None] if at is not None else []
        now = [(s, e, t) for s, e, t in own if s <= at < e]
        return (len(now), len({t for *_, t in now if t is not None}), min((e - at for _, e, _ in now), default=None), sum(at - 730 < e <= at for _, e, _ in own), sum(t == "rail" for *_, t in now), sum(t == "port" for *_, t in now))

    for hot_rows in (10_000, 50):
        monkeypatch.setattr(ts, "HOT_ROWS", hot_rows)
        got = {r.i: tuple(r)[3:] for r in ts.interval_features(df, intervals, "key", "at", "s", "e", "kind", ["rail", "port"]).collect()}
        assert got == {i: by_hand(k, d) for i, k, d in rows}


def test_later_rows_do_not_change_asof_features(spark):
    rows = [("k", 1, 1.0), ("k", 5, 2.0), ("k", 9, 3.0)]
    make = lambda r: ts.rolling_stats(spark.createDataFrame(r, "k string, day int, v double"), ["k"], "day", "v", {"b": (-100, -1)}).withColumn("since", ts.days_since_previous(["k"], "day"))
    before = {r.day: (r.b_median, r.b_n, r.since) for r in make(rows).collect()}
    after = {r.day: (r.b_median, r.b_n, r.since) for r in make([*rows, ("k", 12, 99.0)]).collect()}
    assert all(after[d] == before[d] for d in before)


def test_month_index_widens_pools_and_carries(spark):
    sales = [("s", "p", 10, 1.0), ("s", "p", 10, 3.0), ("t", "p", 13, 5.0)]
    df = spark.createDataFrame(sales, "seg string, pool string, m int, v double")
    got = {(r.seg, r.month): (r.value, r.source) for r in ts.month_index(df, "seg", "pool", "m", "v", 10, 27, 2).collect()}
    assert got["s", 10] == (None, None)
    assert got["s", 11] == (2.0, "segment_3") and got["s", 15] == (2.0, "segment_6") and got["s", 20] == (2.0, "segment_12")
    assert got["t", 14][1] == "pooled_6" and got["s", 25] == (2.0, "carried")


def test_weighted_median_and_fallback(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0)], "k string, y double, w double")
    assert estimates.weighted_median(df, ["k"], "y", "w").first().med == 2.0


def test_shrunken_priors_and_own_fold_left_out(spark):
    df = spark.createDataFrame([("r", "n", 0, 2.0, 1.0), ("r", "n", 1, 4.0, 1.0), ("r", "m", 1, 6.0, 1.0)], "r string, n string, fold int, y double, w double")
    full = {(x.n, x.fold): x.prior_n for x in estimates.shrunken_priors(df, ["r", "n"], "y", "w", 1.0).collect()}
    assert full["n", 0] == pytest.approx((6.0 + 4.0) / 3)
    out = {(x.n, x.fold): (x.prior_r, x.prior_n) for x in estimates.shrunken_priors(df, ["r", "n"], "y", "w", 1.0, "fold").collect()}
    assert out["n", 0] == pytest.approx((5.0, (4.0 + 5.0) / 2)) and out["m", 1] == pytest.approx((2.0, 2.0))


def test_conformal_rank_and_small_segments(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 10)] + [("b", 50.0)], "s string, e double")
    got = {r.s: (r.q, r.top) for r in estimates.conformal_quantiles(df, "s", "e", {"q": 0.5, "top": 0.01}, 5).collect()}
    assert got["a"] == (5.0, math.inf) and got["b"] == (6.0, math.inf)


def test_psi_and_ks_by_hand(spark):
    ref, cur = (spark.createDataFrame([(float(x),) for x in xs], "x double") for xs in ([1, 1, 2, 2], [1, 2, 2, 2]))
    expected = (0.25 - 0.5) * math.log(0.25 / 0.5) + (0.75 - 0.5) * math.log(0.75 / 0.5)
    assert drift.psi_categorical(ref, cur, "x").first().psi == pytest.approx(expected)
    assert drift.ks(ref, cur, "x").first().ks == pytest.approx(0.25)
    flat = spark.createDataFrame([(1.0,)] * 4, "x double")
    assert drift.psi_numeric(flat, flat, "x").first().psi == pytest.approx(0.0)
    assert math.isnan(drift.psi_numeric(flat.limit(0), flat, "x").first().psi)


def test_fusion_collapse_and_metrics(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "q int, d int, rank int")
    got = {r.d: r.score for r in retrieval.fused([a, b], "q", "d").collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61})
    rows = spark.createDataFrame([(1, 10, 1, "c", 5), (1, 11, 2, "c", 3), (1, 12, 3, "e", None)], "q int, d int, rank int, c string, posted int")
    assert [(r.d, r.rank) for r in retrieval.collapsed(rows, "q", "d", F.col("c"), "posted", 5).orderBy("rank").collect()] == [(11, 1), (12, 2)]
    graded = spark.createDataFrame([(1, 1, 0), (1, 2, 3)], "q int, rank int, grade int")
    m = retrieval.ranking_metrics(graded, "q", "grade", 10).first()
    assert m.ndcg == pytest.approx((7 / math.log2(3)) / 7) and m.mrr == 0.5


def test_nearest_excludes_self_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0])], "id long, v array<double>")
    got = [(r.item, r.rank) for r in pairs.nearest(df.where("id = 1"), df, "id", "v", 2).orderBy("rank").collect()]
    assert got == [(3, 1), (4, 2)]


def test_components_of_chain_star_loop_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 200), (100, 300), (300, 300), (7, 7), (500, 500), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[200] == got[300] == 100 and got[500] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_folds_keep_the_horizon_clear_of_the_test(spark):
    rows = spark.createDataFrame([(d,) for d in (0, 50, 89, 95, 100)], "day int")
    got = {(r.fold, r.day): r.role for r in folds.roles(rows, folds.fold_table(spark, 100, 10, 1, 6), "day", 10).collect()}
    assert got == {(0, 0): "train", (0, 50): "train", (0, 89): "gap", (0, 95): "test", (0, 100): "test"}


def test_name_resolution_and_gate(spark):
    aliases = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2)], "alias string, id int")
    got = {r.name: (r.status, r.id) for r in folds.resolve_names(spark.createDataFrame([("x",), ("y",), ("z",)], "name string"), aliases, "name", "alias", "id").collect()}
    assert got == {"x": ("ok", 1), "y": ("ambiguous", None), "z": ("unknown", None)}
    row = folds.gate(spark.createDataFrame([(1.0, None)], "a double, b double"), [("a", F.col("a") > 0), ("b", F.col("b") > 0)]).first()
    assert not row.passed and row.reasons == ["b"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.parse_date(F.lit(" 05-03-2021 "))) == date(2021, 3, 5)
    assert one(scalars.parse_date(F.lit("31-02-2021"))) is None
    assert one(scalars.parse_float(F.lit("inf"))) is None and one(scalars.parse_float(F.lit(" 2.5"))) == 2.5
    assert one(scalars.parse_int(F.lit("3.0"))) == 3 and one(scalars.parse_int(F.lit("3.5"))) is None
    assert one(scalars.match_key(F.lit("Al-Barsha  South (1)"))) == "barsha south 1" and one(scalars.match_key(F.lit(" al "))) is None
    assert one(scalars.display_name(F.lit("  MARINA   GATE "))) == "Marina Gate" and one(scalars.display_name(F.lit("JLT"))) == "JLT"
    assert one(scalars.parse_rooms(F.lit("3 B/R"))).bedrooms == 3 and one(scalars.parse_rooms(F.lit("Studio"))).bedrooms == 0


@pytest.mark.parametrize("text,name", [("AL-BARSHA 2ND", "Al-Barsha 2Nd"), ("  Marsa   Dubai ", "Marsa Dubai"), ("DIFC", "DIFC"), ("   ", None), ("Al-Nahdah", "Al-Nahdah")])
def test_display_names(spark, text, name):
    assert spark.range(1).select(scalars.display_name(F.lit(text)).alias("x")).first().x == name


@pytest.mark.parametrize("text,label,bedrooms", [("penthouse", "Penthouse", None), ("single  ROOM", "Single Room", None), ("3 b/r", "3 B/R", 3), ("STUDIO", "Studio", 0), ("  Loft  ", "Loft", None), ("", None, None)])
def test_rooms(spark, text, label, bedrooms):
    row = spark.range(1).select(scalars.parse_rooms(F.lit(text)).alias("x")).first().x
    assert (row.label, row.bedrooms) == (label, bedrooms)


@pytest.mark.parametrize("gathered", [ranks.GATHERED, 30, 0])
def test_ranks_and_quantiles_of_groups(spark, monkeypatch, gathered):
    """Groups that are sorted whole, and those that a range sort spreads, give the same."""
    monkeypatch.setattr(ranks, "GATHERED", gathered)
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else int(g), float(v)) for g, v in zip(rng.choice(4, 500, p=[0.7, 0.2, 0.05, 0.05]), rng.integers(0, 40, 500))] + [(9, None), (8, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5, "high": 0.99}).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(own) and np.allclose([got[g].low, got[g].mid, got[g].high], np.quantile(own, [0.1, 0.5, 0.99]))
    assert 9 not in got
    whole = ranks.at_ranks(df, [], "v", {"least": F.lit(0), "beyond": F.lit(10_000)}).first()
    assert whole.n == 501 and whole.least == min(v for _, v in rows if v is not None) and whole.beyond is None
    summed = ranks.running(df.where("v is not null"), [F.col("v")], ["v"], falling=1).orderBy("rank").collect()
    assert [r.rank for r in summed] == list(range(501)) and np.allclose([r.cum_v for r in summed], np.cumsum(sorted((v for _, v in rows if v is not None), reverse=True)))
    assert ranks.quantiles(df.limit(0), ["g"], "v", {"mid": 0.5}).count() == 0
