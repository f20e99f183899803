"""Ledger, reports, curated references, stored flags and grouped folds."""

from pyspark.sql import functions as F

from terrane.operators import folds
from terrane.products import listings
from terrane.sources import readers, sinks


def test_stale_and_abandoned_runs(spark):
    rows = [("r1", "load", "succeeded", "2024-01-01 10:00:00"), ("r2", "train", "succeeded", "2024-01-01 11:00:00"), ("r3", "load", "succeeded", "2024-01-02 10:00:00"), ("r4", "train", "started", "2024-01-02 11:00:00"), ("r5", "train", "started", "2024-01-02 11:30:00"), ("r5", "train", "failed", "2024-01-02 11:40:00")]
    ledger = spark.createDataFrame(rows, "run_id string, name string, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sinks.stale(ledger, "train", "load").first().stale is True
    assert sinks.stale(ledger.where("run_id <> 'r3'"), "train", "load").first().stale is False
    assert sinks.stale(ledger, "never", "load").first().stale is True
    old = sinks.abandoned(ledger, "train", F.lit("2024-01-03").cast("timestamp")).collect()
    assert [r.run_id for r in old] == ["r4"]
    assert sinks.abandoned(ledger, "train", F.lit("2024-01-02 10:30:00").cast("timestamp")).count() == 0


def test_reports_replace_what_was_there(spark, tmp_path):
    for kind, read in (("csv", lambda p: spark.read.option("header", True).csv(p)), ("json", spark.read.json)):
        path = str(tmp_path / kind)
        sinks.write_report(spark.range(3).withColumn("x", F.lit("a")), path, kind)
        sinks.write_report(spark.range(2).withColumn("x", F.lit("b")), path, kind)
        assert sorted((int(r.id), r.x) for r in read(path).collect()) == [(0, "b"), (1, "b")]


def test_curated_projects(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,opens,areas\nMetro , 2024-05-01,1; 2;x\nPort,soon,\n")
    got = {r.name: r for r in readers.read_projects(spark, str(tmp_path / "p.csv"), ["name", "opens", "areas"], ["opens"], ["areas"]).collect()}
    assert str(got["Metro"].opens) == "2024-05-01" and got["Metro"].areas == [1, 2, None]
    assert got["Port"].opens is None and got["Port"].opens_raw == "soon" and got["Port"].areas is None


def test_stored_flags_have_a_row_for_each_asked_id(spark):
    flagged = spark.createDataFrame([(1, "photo_reuse", "{}"), (1, "bait_price", "{}"), (9, "bait_price", "{}")], "id int, flag string, detail string")
    got = {r.id: [f.flag for f in r.flags] for r in listings.stored(flagged, spark.createDataFrame([(1,), (2,), (2,)], "id int")).collect()}
    assert got == {1: ["bait_price", "photo_reuse"], 2: []}


def test_groups_do_not_cross_folds(spark):
    rows = spark.range(600).select("id", (F.col("id") % 70).cast("string").alias("g")).withColumn("fold", folds.grouped_fold(F.col("g"), 5))
    assert rows.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {0, 1, 2, 3, 4}
