"""Area statistics: a twelve-month summary and a monthly history."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import ranks


@dataclass
class AreaStats:
    """sales: area, kind, day (date), price."""

    sales: DataFrame
    min_sales: int = 5
    months: int = 96

    def summary(self) -> DataFrame:
        rows = self.sales.join(F.broadcast(self.sales.agg(F.max("day").alias("last"))))
        now = F.col("day") > F.add_months("last", -12)
        before = ~now & (F.col("day") > F.add_months("last", -24))
        year = F.when(now, "now").when(before, "before")
        medians = ranks.quantiles(rows.withColumn("year", year).where("year is not null"), ["area", "kind", "year"], "price", {"median": 0.5})
        medians = medians.groupBy("area", "kind").agg(*[F.max(F.when(F.col("year") == y, F.col("median"))).alias(y) for y in ("now", "before")])
        counts = rows.groupBy("area", "kind").agg(F.count_if(now).alias("sales"))
        same = counts["area"].eqNullSafe(medians["area"]) & counts["kind"].eqNullSafe(medians["kind"])
        out = counts.join(medians, same, "left").select(counts["area"], counts["kind"], "sales", "now", "before")
        return out.where(F.col("sales") >= self.min_sales).withColumn("change", F.try_divide("now", "before") - 1)

    def history(self) -> DataFrame:
        rows = self.sales.join(F.broadcast(self.sales.agg(F.max("day").alias("last")))).where(F.col("day") > F.add_months("last", -self.months))
        monthly = rows.withColumn("month", F.trunc("day", "month"))
        keys = ["area", "kind", "month"]
        counts = monthly.groupBy(*keys).agg(F.count(F.lit(1)).alias("sales"))
        medians = ranks.quantiles(monthly, keys, "price", {"median": 0.5})
        same = reduce(lambda a, b: a & b, [counts[k].eqNullSafe(medians[k]) for k in keys])
        enough = F.when(F.col("sales") >= self.min_sales, F.col("median")).alias("median")
        return counts.join(medians, same, "left").select(*[counts[k] for k in keys], "sales", enough)
