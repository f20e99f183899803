"""Row classification: ordered rules, repeated ids, problem lists and tiered robust outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import ranks
from terrane.session import cut

#: Fixed values of the outlier test.
MAD_SCALE, MIN_SCALE, THRESHOLD, MIN_PEERS = 1.4826, 0.12, 3.5, 30


def first_match(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition is true; null where none is. A null condition does not match."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, condition in rules:
        chain = chain.when(condition, F.lit(name))
    return chain


def is_repeat(keys: list[str], order: list[Column | str]) -> Column:
    """True for all but the first row of each key in the given order; null keys equal each other."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def problems(rules: list[tuple[str, Column]]) -> Column:
    """The messages of all rules that a row breaks, in order."""
    return F.filter(F.array(*[F.when(bad, F.lit(message)) for message, bad in rules]), lambda m: m.isNotNull())


def drop_counts(df: DataFrame, rules: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """(reason, n): rows that sequential filters drop at each step, in one pass, and those that are kept."""
    return df.select(F.coalesce(first_match(rules), F.lit(kept)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Groups of a tier from which on it is spread well enough by its keys.
NARROW_GROUPS = 1000


def _keys_of(tiers: dict[int, list[str]]) -> list[str]:
    return list(dict.fromkeys(k for tier in tiers.values() for k in tier))


def _by_tier(df: DataFrame, tiers: list[list[str]] | dict[int, list[str]], values: list[Column]) -> DataFrame:
    """One row per row and tier: the tier's number, its keys (others null) and its value."""
    tiers = tiers if isinstance(tiers, dict) else dict(enumerate(tiers, 1))
    keys = _keys_of(tiers)
    null = {k: F.lit(None).cast(df.schema[k].dataType) for k in keys}
    rows = [F.struct(F.lit(i).alias("tier"), *[(F.col(k) if k in tier else null[k]).alias(k) for k in keys], value.alias("value")) for (i, tier), value in zip(tiers.items(), values, strict=True)]
    return df.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def tiered_robust_z(df: DataFrame, value: str, tiers: list[list[str]], min_peers: int = MIN_PEERS, strict: bool = False) -> DataFrame:
    """Adds peer_tier (1 for the first tier with enough peers and spread), robust_z, med and scale; a row that no tier
    serves has nulls, or fails if `strict`.

    Tiers of many groups, all of them small, take their medians and deviations in windows over one shuffle of the rows
    by the keys that these tiers share, each group in one task. Those of other tiers come from ranks.quantiles, which
    deals counts of large groups only, and are joined back, broadcast by Spark where they are small.
    """
    keys = list(dict.fromkeys(k for tier in tiers for k in tier))
    df = cut(df, "peers")
    cells = cut(df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")), "cells")
    sizes = _by_tier(cells, tiers, [F.col("__c")] * len(tiers)).groupBy("tier", *keys).agg(F.sum("value").alias("n"))
    own = {r.tier: r for r in sizes.groupBy("tier").agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).collect()}
    narrow = [i for i, r in sorted(own.items()) if r.groups >= NARROW_GROUPS and r.most <= ranks.GATHERED]
    wide = [i for i in range(1, len(tiers) + 1) if i not in narrow]
    out = df

    def joined(rows: DataFrame, found: DataFrame, names: dict[str, str]) -> DataFrame:
        for i in wide:
            own = found.where(F.col("tier") == i).select(*tiers[i - 1], *[F.col(c).alias(f"{name}{i}") for c, name in names.items()])
            rows = _join_null_safe(rows, own, tiers[i - 1])
        return rows

    if wide:
        chosen = {i: tiers[i - 1] for i in wide}
        stats = cut(ranks.quantiles(_by_tier(df, chosen, [F.col(value)] * len(wide)), ["tier", *_keys_of(chosen)], "value", {"med": 0.5}), "tiers")
        out = joined(out, stats, {"med": "__med", "n": "__n"})
        gaps = [F.abs(F.col(value) - F.col(f"__med{i}")) for i in wide]
        mads = cut(ranks.quantiles(_by_tier(out, chosen, gaps), ["tier", *_keys_of(chosen)], "value", {"mad": 0.5}), "tiers")
    if narrow:
        order = list(dict.fromkeys(k for i in sorted(narrow, key=lambda i: len(tiers[i - 1])) for k in tiers[i - 1]))
        shared = [k for k in order if all(k in tiers[i - 1] for i in narrow)]
        out = out.repartition(*shared) if shared else out
        for i in sorted(narrow, key=lambda i: -len(tiers[i - 1])):
            w = Window.partitionBy(*[k for k in order if k in tiers[i - 1]])
            out = out.withColumns({f"__med{i}": F.percentile(value, 0.5).over(w), f"__n{i}": F.count(value).over(w)})
            out = out.withColumn(f"__mad{i}", F.percentile(F.abs(F.col(value) - F.col(f"__med{i}")), 0.5).over(w))
    if wide:
        out = joined(out, mads, {"mad": "__mad"})
    n = len(tiers)
    usable = [(F.col(f"__n{i}") >= min_peers) & (F.col(f"__mad{i}") > 0) for i in range(1, n + 1)]
    pick = lambda what: reduce(lambda chain, i: chain.when(usable[i - 1], F.col(f"__{what}{i}")), range(1, n + 1), F.when(F.lit(False), F.lit(None).cast("double")))
    tier = reduce(lambda chain, i: chain.when(usable[i - 1], F.lit(i)), range(1, n + 1), F.when(F.lit(False), F.lit(None).cast("int")))
    if strict:
        tier = tier.otherwise(F.raise_error(F.lit(f"no peer group has {min_peers} rows and a spread")).cast("int"))
    out = out.withColumns({"peer_tier": tier, "med": pick("med"), "scale": F.greatest(F.lit(MAD_SCALE) * pick("mad"), F.lit(MIN_SCALE))})
    out = out.withColumn("robust_z", (F.col(value) - F.col("med")) / F.col("scale"))
    return out.drop(*[f"__{what}{i}" for what in ("med", "n", "mad") for i in range(1, n + 1)])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"__r_{k}" for k in keys])


def outlier_reason(z: Column, shifted: Column, threshold: float = THRESHOLD, names: tuple[str, str, str] = ("suspected_unit", "outlier_low", "outlier_high")) -> Column:
    """Low because of another unit (the shifted z lies within the threshold), low, or high."""
    unit, low, high = names
    return first_match([(unit, (z < -threshold) & (F.abs(shifted) <= threshold)), (low, z < -threshold), (high, z > threshold)])


def group_mad_screen(df: DataFrame, value: str, keys: list[str], min_group: int = 10, threshold: float = 3.0) -> DataFrame:
    """Adds `outlier`: beyond `threshold` robust deviations within its group; small or flat groups are not screened."""
    df = cut(df, "screened")
    med = ranks.quantiles(df, keys, value, {"__med": 0.5}).withColumnRenamed("n", "__n")
    with_med = cut(_join_null_safe(df, med, keys), "centred")
    mad = ranks.quantiles(with_med.withColumn("__gap", F.abs(F.col(value) - F.col("__med"))), keys, "__gap", {"__mad": 0.5}).drop("n")
    out = _join_null_safe(with_med, mad, keys)
    z = (F.col(value) - F.col("__med")) / (F.lit(MAD_SCALE) * F.col("__mad"))
    hit = F.when((F.col("__n") >= min_group) & (F.col("__mad") > 0), F.abs(z) > threshold)
    return out.withColumn("outlier", F.coalesce(hit, F.lit(False))).drop("__med", "__n", "__mad")
