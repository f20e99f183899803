"""Cached batch scores: what is scored again, and what is kept."""

from pyspark.sql import functions as F

from terrane.products.scoring import rescored


def test_only_changed_rows_are_scored(spark):
    seen = []

    def score(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.withColumn("score", F.col("a") * 2.0)

    make = lambda rows: spark.createDataFrame(rows, "id int, a double, b string, other int")
    first = [(1, 1.0, "x", 0), (2, 2.0, None, 0), (3, None, "z", 0)]
    last, counts = rescored(make(first), None, "id", ["a", "b"], "v1", score)
    assert counts == {"total": 3, "scored": 3, "kept": 0, "unscorable": 1}
    same, counts = rescored(make([(i, a, b, 9) for i, a, b, _ in first]), last, "id", ["a", "b"], "v1", score)
    assert counts["scored"] == 0 and seen[-1] == [] and sorted(map(tuple, same.select("id", "score").collect()), key=str) == [(1, 2.0), (2, 4.0), (3, None)]
    changed, counts = rescored(make([(1, 5.0, "x", 0), (2, 2.0, "", 0), (4, 4.0, "n", 0)]), same, "id", ["a", "b"], "v1", score)
    assert seen[-1] == [1, 2, 4] and counts == {"total": 3, "scored": 3, "kept": 0, "unscorable": 0}
    _, counts = rescored(make([(1, 5.0, "x", 0)]), changed, "id", ["a", "b"], "v2", score)
    assert counts["scored"] == 1
    assert rescored(make([]), changed, "id", ["a", "b"], "v1", score)[1]["total"] == 0
