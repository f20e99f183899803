"""Queries on event streams; each also runs on a real stream in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans.catalogue import query
from terrane.session import table
from terrane.streaming import limiter


@query()
def st1_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted and refused requests per user under two tokens and one more every six hours."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    out = limiter.admitted(rows, "user_id", "at", "event_id", 2.0, 1 / 21600)
    return out.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))
