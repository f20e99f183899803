"""Generated corpora: the same for any partitioning, sound, and with what was planted."""

import collections

from pyspark.sql import functions as F

from terrane.products import generator


def homes(spark, n=4000):
    return spark.range(n).select("id", (F.col("id") % 9).alias("area"), F.lit("flat").alias("kind"), (F.col("id") % 4).cast("int").alias("bedrooms"), (F.col("id") % 90 + 30).alias("size"), (F.col("id") % 700 + 300.0).alias("price"), F.lit("2024-03-01").cast("date").alias("posted"))


def test_corpus_does_not_depend_on_partitions_or_other_rows(spark):
    rows = homes(spark)
    one = sorted(map(tuple, generator.corpus(rows.coalesce(1)).collect()), key=str)
    eight = sorted(map(tuple, generator.corpus(rows.repartition(8, "size")).collect()), key=str)
    assert one == eight
    part = {tuple(r) for r in generator.corpus(rows.where("id % 10 = 3")).collect()}
    assert part <= set(one) and generator.corpus(rows.limit(0)).count() == 0
    assert sorted(map(tuple, generator.corpus(rows, seed=18).collect()), key=str) != one


def test_corpus_is_sound_and_has_what_is_planted(spark):
    listings = generator.corpus(homes(spark)).cache()
    assert generator.corpus_problems(listings).count() == 0
    counts = collections.Counter(r.pattern for r in listings.collect())
    assert all(50 < counts[p] < 120 for p in generator.PATTERNS) and counts[None] == 4000
    controls = collections.Counter(r.control for r in listings.collect())
    assert all(120 < controls[c] < 260 for c in generator.CONTROLS)
    broken = listings.withColumn("price", F.when(F.col("pattern") == "repost", F.col("price") + 1).otherwise(F.col("price"))).where("source is not null or pattern is null")
    assert {r.problem for r in generator.corpus_problems(broken).collect()} == {"a repost with another price or text"}
