"""Walk-forward folds, leak guards, gates and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_table(spark, last: int, step: int, count: int, length: int) -> DataFrame:
    """(fold, start, stop): `count` test periods of `length` days on a grid that is anchored at the last day."""
    rows = [(count - 1 - i, last - i * step - length + 1, last - i * step) for i in range(count)]
    return spark.createDataFrame(rows, "fold int, start int, stop int")


def roles(rows: DataFrame, folds: DataFrame, day: str, horizon: int) -> DataFrame:
    """Each row in each fold as test, train or gap; training rows must see their whole horizon before the test starts."""
    at = F.col(day)
    role = F.when(at.between(F.col("start"), F.col("stop")), "test").when(at + horizon < F.col("start"), "train").when(at < F.col("start"), "gap")
    return rows.join(F.broadcast(folds)).withColumn("role", role).where("role is not null")


def grouped_fold(key: Column, k: int) -> Column:
    """A fold that depends on the group alone, so no group crosses folds."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def resolve_names(asked: DataFrame, aliases: DataFrame, name: str, alias: str, target: str) -> DataFrame:
    """Adds the target id and a status: ok, unknown or ambiguous."""
    known = aliases.groupBy(F.col(alias).alias("__a")).agg(F.count_distinct(target).alias("__n"), F.min(target).alias("__t"))
    out = asked.join(known, F.col(name) == F.col("__a"), "left")
    status = F.when(F.col("__n").isNull(), "unknown").when(F.col("__n") > 1, "ambiguous").otherwise("ok")
    return out.withColumns({"status": status, target: F.when(F.col("__n") == 1, F.col("__t"))}).drop("__a", "__n", "__t")


def gate(metrics: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds passed and the reasons of all checks that fail; a null check fails."""
    reasons = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in checks]), lambda r: r.isNotNull())
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
