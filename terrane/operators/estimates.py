"""Weighted medians, shrunken priors, quantile bounds, conformal ranges and error metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import ranks


def top_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the commonest value of each key, the smaller one on a tie."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.asc_nulls_last(value)))
    return counts.withColumn("__r", best).where("__r = 1").drop("__r")


def dominant_value(df: DataFrame, key: str, value: str, min_rows: int, min_share: float) -> DataFrame:
    """(key, value, n, total): the commonest value of a key if it has enough rows and a large enough share."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    ranked = counts.withColumns({"total": F.sum("n").over(w), "__r": F.row_number().over(w.orderBy(F.desc("n"), value))})
    return ranked.where((F.col("__r") == 1) & (F.col("total") >= min_rows) & (F.col("n") / F.col("total") >= min_share)).drop("__r")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, med, total): the smallest value whose cumulative weight reaches half of the group's.

    Weights of equal values are summed first, so a heavy group shrinks before it is sorted.
    """
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    running = summed.withColumns({"__cw": F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__tw": F.sum("__w").over(w)})
    return running.where("__cw >= __tw / 2").groupBy(*keys).agg(F.min(value).alias("med"), F.first("__tw").alias("total"))


def with_fallback(df: DataFrame, tables: list[tuple[DataFrame, list[str]]], value: str, count: str, min_n: float, out: str) -> DataFrame:
    """Adds the first table's value with enough weight, narrow keys first; the last table counts in any case."""
    for i, (table, keys) in enumerate(tables):
        df = df.join(table.select(*keys, F.col(value).alias(f"__v{i}"), F.col(count).alias(f"__n{i}")), keys, "left")
    chain = reduce(lambda c, i: c.when(F.col(f"__n{i}") >= min_n, F.col(f"__v{i}")), range(len(tables) - 1), F.when(F.lit(False), F.lit(None).cast("double")))
    return df.withColumn(out, chain.otherwise(F.col(f"__v{len(tables) - 1}"))).drop(*[f"__{x}{i}" for x in "vn" for i in range(len(tables))])


def shrunken_priors(df: DataFrame, levels: list[str], value: str, weight: str, k: float, fold: str | None = None) -> DataFrame:
    """Adds prior_<level> for nested levels, each (sum(w y) + k * parent) / (sum(w) + k), and n_<level>.

    With a fold column, a row's priors leave out its own fold: per-level totals less per-fold sums, in one pass and
    without a loop over folds. The first level is the root and is not shrunk.
    """
    out, parent = df, None
    for i, level in enumerate(levels):
        keys = levels[: i + 1]
        sums = [F.sum(F.col(value) * F.col(weight)).alias("__wy"), F.sum(weight).alias("__w")]
        table = df.groupBy(*keys).agg(*sums)
        out = out.join(table, keys, "left")
        if fold:
            own = df.groupBy(*keys, fold).agg(sums[0].alias("__fwy"), sums[1].alias("__fw"))
            out = out.join(own, [*keys, fold], "left").withColumns({"__wy": F.col("__wy") - F.coalesce("__fwy", F.lit(0.0)), "__w": F.col("__w") - F.coalesce("__fw", F.lit(0.0))}).drop("__fwy", "__fw")
        wy, w = F.coalesce("__wy", F.lit(0.0)), F.coalesce("__w", F.lit(0.0))
        prior = F.when(w > 0, wy / w) if parent is None else (wy + F.lit(k) * F.col(parent)) / (w + F.lit(k))
        parent = f"prior_{level}"
        out = out.withColumns({parent: prior, f"n_{level}": w}).drop("__wy", "__w")
    return out


def quantile_bounds(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """(keys, low, high, n): linear quantiles per group."""
    return ranks.quantiles(df, keys, value, {"low": low, "high": high}).select(*keys, "low", "high", "n")


def conformal_quantiles(df: DataFrame, segment: str, error: str, alphas: dict[str, float], min_rows: int) -> DataFrame:
    """(segment, <name>..., n): the ceil((n + 1)(1 - a))-th smallest error, infinite beyond n; small segments get the
    pooled value. Errors are looked up by rank after a range sort, so neither a segment nor the pool is gathered."""
    picks = {name: F.ceil((F.col("n") + 1) * F.lit(1 - a)) - 1 for name, a in alphas.items()}
    beyond = lambda name: F.coalesce(F.col(name), F.lit(float("inf")))
    pooled = ranks.at_ranks(df, [], error, picks).select(*[beyond(name).alias(f"__{name}") for name in alphas])
    own = ranks.at_ranks(df, [segment], error, picks).join(F.broadcast(pooled))  # one row
    return own.select(segment, "n", *[F.when(F.col("n") >= min_rows, beyond(name)).otherwise(F.col(f"__{name}")).alias(name) for name in alphas])


def error_metrics(df: DataFrame, actual: str, predicted: str, sets: list[list[str]]) -> DataFrame:
    """MdAPE, shares within 10 and 20 percent, RMSE of logs and n, for several groupings in one GROUPING SETS; medians of
    large groups come from a range sort."""
    ape = F.abs(F.col(predicted) - F.col(actual)) / F.col(actual)
    rows = df.withColumns({"__ape": ape, "__log": F.pow(F.ln(predicted) - F.ln(actual), 2)})
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    out = grouped.agg(F.grouping_id().alias("__set"), F.avg((F.col("__ape") <= 0.1).cast("double")).alias("ppe10"), F.avg((F.col("__ape") <= 0.2).cast("double")).alias("ppe20"), F.sqrt(F.avg("__log")).alias("rmse_log"), F.count(F.lit(1)).alias("n"))
    # the same rows once for each set, as grouping sets have them: absent columns null, the set by its grouping id
    ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for s in sets]
    each = [F.struct(F.lit(n).cast("long").alias("__set"), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in columns]) for n, s in zip(ids, sets, strict=True)]
    spread = rows.select("__ape", F.explode(F.array(*each)).alias("__k")).select("__ape", "__k.*")
    medians = ranks.quantiles(spread, ["__set", *columns], "__ape", {"mdape": 0.5}).drop("n").withColumnsRenamed({c: f"__r_{c}" for c in ["__set", *columns]})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in ["__set", *columns]])
    return out.join(medians, on, "left").select(*columns, "mdape", "ppe10", "ppe20", "rmse_log", "n")


def recency_weight(age_days: Column, half_life: float, bulk: Column) -> Column:
    """Half the weight for each half-life of age, times one over the size of a bulk sale."""
    return F.pow(F.lit(0.5), age_days / F.lit(half_life)) / bulk


def binary_metrics(df: DataFrame, label: Column, predicted: Column, keys: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 per group; a share without a base is null."""
    rows = df.withColumns({"__y": label.cast("int"), "__p": predicted.cast("int")})
    out = rows.groupBy(*keys).agg(F.count_if(F.expr("__y = 1 and __p = 1")).alias("tp"), F.count_if(F.expr("__y = 0 and __p = 1")).alias("fp"), F.count_if(F.expr("__y = 1 and __p = 0")).alias("fn"), F.count_if(F.expr("__y = 0 and __p = 0")).alias("tn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"))})


def precision_recall(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Adds rank, hits, precision and recall by falling score, ties by key; a task counts one range of scores."""
    counted = ranks.running(df, [F.col(score), F.col(key)], [label], falling=1)
    out = counted.withColumns({"rank": (F.col("rank") + 1).cast("int"), "hits": F.col(f"cum_{label}")})
    return out.withColumns({"precision": F.col("hits") / F.col("rank"), "recall": F.try_divide("hits", f"total_{label}")}).drop(f"cum_{label}", f"total_{label}")
