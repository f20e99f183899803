"""Population stability, Kolmogorov-Smirnov distance and log statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import ranks
from terrane.session import cut

#: Fixed floor of a bin's share.
EPSILON = 1e-4


def _finite(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _index(counts: DataFrame) -> DataFrame:
    """counts: r, c of each bin or category. The stability index of the two distributions, NaN if one is empty."""
    counts = cut(counts.select("r", "c"), "bins")
    totals = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))  # one row
    shares = counts.join(F.broadcast(totals)).select(*[F.greatest(F.try_divide(x, f"n{x}"), F.lit(EPSILON)).alias(x) for x in "rc"], "nr", "nc")
    total = F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r")))
    return shares.agg(F.when((F.max("nr") > 0) & (F.max("nc") > 0), total).otherwise(F.lit(float("nan"))).alias("psi"))


def psi_numeric(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """PSI over quantile bins of the reference; a constant reference uses below, equal and above."""
    ref, cur = _finite(reference, value), _finite(current, value)
    names = [f"q{i}" for i in range(bins + 1)]
    found = ranks.quantiles(ref, [], "x", {name: i / bins for i, name in enumerate(names)})
    edges = found.select(F.array_distinct(F.array(*names)).alias("e"))
    edges = edges.select(F.when(F.size("e") == 1, F.col("e")).otherwise(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))).alias("inner"), (F.size("e") == 1).alias("flat"))
    both = ref.withColumns({"r": F.lit(1), "c": F.lit(0)}).unionByName(cur.withColumns({"r": F.lit(0), "c": F.lit(1)})).join(F.broadcast(edges), how="left")
    slot = F.size(F.filter("inner", lambda e: e <= F.col("x")))
    slot = F.when(F.col("flat"), F.when(F.col("x") < F.col("inner")[0], -1).when(F.col("x") == F.col("inner")[0], 0).otherwise(1)).otherwise(slot)
    return _index(both.groupBy(slot.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c")))


def psi_categorical(reference: DataFrame, current: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """PSI over category shares; null is a category, and those beyond the reference's first `top` are one."""
    label = F.coalesce(F.col(value).cast("string"), F.lit("<null>"))
    both = reference.select(label.alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(label.alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = both.groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    if top is not None:
        keep = counts.where("r > 0").orderBy(F.desc("r"), "v").limit(top).select("v", F.lit(True).alias("keep"))
        counts = counts.join(F.broadcast(keep), "v", "left").groupBy(F.when(F.col("keep"), F.col("v")).otherwise("<other>").alias("v")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return _index(counts)


def ks(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Largest gap of the two empirical distributions. Equal values are summed before the running counts."""
    both = _finite(reference, value).withColumns({"r": F.lit(1), "c": F.lit(0)}).unionByName(_finite(current, value).withColumns({"r": F.lit(0), "c": F.lit(1)}))
    counts = both.groupBy("x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    summed = ranks.running(counts, [F.col("x")], ["r", "c"])
    share = lambda x: F.try_divide(f"cum_{x}", f"total_{x}")
    return summed.select(F.abs(share("r") - share("c")).alias("gap")).agg(F.coalesce(F.max("gap"), F.lit(float("nan"))).alias("ks"))


def histogram(df: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """(keys, le, n): cumulative counts below fixed bounds, as of a latency histogram."""
    le = F.explode(F.array(*[F.lit(float(b)) for b in bounds]))
    return df.select(*keys, value.alias("__x"), le.alias("le")).groupBy(*keys, "le").agg(F.count_if(F.col("__x") <= F.col("le")).alias("n"))
