"""Slots against listings by hand, wording, and what scratch leaves."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import wording
from terrane.products import matching
from terrane.products.queries import parsed
from terrane.session import cut, scratch

ASKED = "2 bed flat under 1m over 100 sqm balcony gym"
LISTINGS = [
    (1, "flat", 2, 900_000.0, 100.0, "Balcony and gym access", 3, 3, []),
    (2, "flat", 3, 900_000.0, 100.0, "balcony, gym access", 2, 2, ["bedrooms comes close"]),
    (3, "flat", 2, 1_050_000.0, 95.0, "balcony gym access", 1, 1, ["budget comes close", "size comes close"]),
    (4, "villa", 2, 900_000.0, 100.0, "balcony gym access", 1, 0, ["type differs"]),
    (5, "flat", None, 900_000.0, 100.0, "balcony gym access", 1, 1, ["bedrooms differs"]),
    (6, "flat", 2, 900_000.0, 120.0, "gym access", 2, 2, ["amenities comes close"]),
    (7, "flat", 2, None, 120.0, None, 1, 1, ["budget differs", "amenities differs"]),
]


def test_grades_and_notes(spark):
    asked = parsed(spark.createDataFrame([(ASKED,)], "text string")).select(F.col("slots").alias("asked"))
    rows = spark.createDataFrame([x[:6] for x in LISTINGS], "id int, kind string, bedrooms int, price double, size double, text string").join(F.broadcast(asked))
    slots = matching.slots_of(F.col("asked"), {c: F.col(c) for c in ("kind", "bedrooms", "price", "size", "text")})
    features = matching.ranking_features(F.col("asked"), {c: F.col(c) for c in ("kind", "bedrooms", "price", "size", "text")}, {}, F.lit("2024-01-01").cast("date"))
    assert tuple(features) == matching.FEATURES and len(features) == 25
    got = {r.id: r for r in rows.select("id", matching.rule_grade(slots).alias("rule"), matching.true_grade(slots, F.col("id") == 6).alias("true"), matching.match_notes(slots).alias("notes"), *[c.alias(n) for n, c in features.items()]).collect()}
    for i, *_, rule, true, notes in LISTINGS:
        assert (got[i].rule, got[i].true) == (rule, min(true, 1) if i == 6 else true), i
        assert [n for n in got[i].notes if not n.endswith("matches")] == notes
    assert got[2].beds_diff == 1 and math.isnan(got[5].beds_diff) and got[3].price_over_max == pytest.approx(0.05) and math.isnan(got[1].area_match) and got[1].amenity_hits == 2


def test_wording(spark):
    row = spark.range(1).select(
        wording.driver_lines(F.array(F.struct(F.lit("momentum_1y").alias("name"), F.lit(0.0198).alias("value")), F.struct(F.lit("x").alias("name"), F.lit(-0.5).alias("value"))), {"x": "price level"}).alias("drivers"),
        wording.exclusion_line(F.lit(12), F.lit(300), F.lit("no price")).alias("line"),
        wording.exclusion_line(F.lit(0), F.lit(300), F.lit("no price")).alias("none"),
    ).first()
    assert row.drivers == ["momentum 1y +2.0%", "price level -39.3%"] and row.line == "12 of 300 left out (4.0%): no price" and row.none is None


def test_a_failed_stage_leaves_no_tables(spark):
    paths = []
    with pytest.raises(RuntimeError), scratch(spark):
        paths.append(cut(spark.range(3), "left").inputFiles()[0])
        raise RuntimeError
    with scratch(spark):
        cut(spark.range(3), "left")
        kept = cut(spark.range(4), "kept")
    assert kept.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(paths[0].rsplit("/", 1)[0]).count()
