"""Ranks, running sums and exact quantiles of groups of any size.

A window over all rows, or an exact percentile of a group with a third of them, passes through one task. Here rows are
dealt by ranges of their order, the last key being a number of their own, so that ties are dealt too; a row's rank is
its place in its range and what lies before that, one number for each task. Quantiles of large groups need no sort:
their ranges are cut into parts, and only counts of the parts are dealt until few values are left.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from terrane.session import cut

#: Monotonically increasing ids hold the partition above these bits and the place in it below.
PLACE_BITS = 33
#: Values of a group that one task sorts at most.
GATHERED = 100_000


def ranked(df: DataFrame, order: list[Column], falling: int = 0) -> DataFrame:
    """Adds part (the range) and rank (from 0, gapless, in the given order, the first `falling` keys from high to low),
    as a written table."""
    spark = df.sparkSession
    keys = [F.desc(f"__o{i}") if i < falling else F.asc(f"__o{i}") for i in range(len(order) + 1)]
    rows = df.select(F.struct("*").alias("__row"), *[c.alias(f"__o{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias(f"__o{len(order)}"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    table = cut(dealt.select("__row.*", F.monotonically_increasing_id().alias("__place")), "ranked")
    part = F.shiftright("__place", PLACE_BITS)
    counts = sorted((r.part, r.n) for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one for each task
    starts, before = [], 0
    for number, n in counts:
        starts.append((number, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, __before long")
    out = table.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.withColumn("rank", F.col("__before") + F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)).drop("__before", "__place")


def running(df: DataFrame, order: list[Column], values: list[str], falling: int = 0) -> DataFrame:
    """Adds rank, cum_<value> (the sum up to and with the row) and total_<value>; a task sums one range."""
    rows = ranked(df, order, falling)
    sums = sorted(map(tuple, rows.groupBy("part").agg(*[F.sum(v) for v in values]).collect()))  # one for each task
    kinds = [rows.select(F.sum(v).alias("s")).schema["s"].dataType.simpleString() for v in values]
    zero = lambda kind: 0.0 if kind == "double" else Decimal(0) if kind.startswith("decimal") else 0
    before, starts = [zero(kind) for kind in kinds], []
    for number, *own in sums:
        starts.append((number, *before))
        before = [a if b is None else a + b for a, b in zip(before, own, strict=True)]
    offsets = df.sparkSession.createDataFrame(starts, ", ".join(["part long", *[f"__b{i} {k}" for i, k in enumerate(kinds)]]))
    w = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), "part")
    cumulated = {f"cum_{v}": F.col(f"__b{i}") + F.coalesce(F.sum(v).over(w), F.lit(0)) for i, v in enumerate(values)}
    totals = {f"total_{v}": F.lit(t).cast(k) for v, t, k in zip(values, before, kinds, strict=True)}
    return out.withColumns(cumulated | totals).drop("part", *[f"__b{i}" for i in range(len(values))])


def at_ranks(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """(keys, n, names): of each group the value at the rank (from 0, within the group, by rising value) that a pick
    gives in terms of n; null where the rank is null or beyond the group. Null values are left out, null keys equal.

    Groups of up to GATHERED values are sorted whole, each in one task. Of larger ones only counts are dealt: see
    counted(). df is read once for the sizes, once for the small groups and twice for the large ones."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__all"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("__g"), F.col(value).alias("__v"))
    sizes = cut(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), *ends(rows)), "sizes")
    large = cut(sizes.where(F.col("n") > GATHERED).withColumn("__i", F.monotonically_increasing_id()), "large")
    many = large.count()
    small = rows if not many else rows.join(_attached(large.select("__g"), many), "__g", "left_anti")
    place = F.row_number().over(Window.partitionBy("__g").orderBy("__v")) - 1
    small = small.withColumns({"__r": place, "n": F.count(F.lit(1)).over(Window.partitionBy("__g"))})
    out = small.groupBy("__g", "n").agg(*[F.max(F.when(F.col("__r") == at, F.col("__v"))).alias(name) for name, at in picks.items()])
    if many:
        asked = F.array(*[F.struct(F.lit(name).alias("pick"), F.when(at.between(0, F.col("n") - 1), at).cast("long").alias("rank")) for name, at in picks.items()])
        wanted = cut(large.select("__g", "__i", "n", F.explode(asked).alias("__p")).select("__g", "__i", "n", "__p.*"), "wanted")  # large groups times picks
        numbered = rows.join(_attached(large.select("__g", "__i", "__lo", "__hi"), many), "__g").select("__i", "__lo", "__hi", "__v", F.lit(1).alias("__c"))
        if sizes.where(F.col("n") <= GATHERED).isEmpty():
            out = out.limit(0)
        values = counted(numbered, wanted.where("rank is not null").select("__i", "rank").distinct(), many)
        found = wanted.join(values, ["__i", "rank"], "left")
        out = out.unionByName(found.groupBy("__g", "n").agg(*[F.max(F.when(F.col("pick") == name, F.col("__v"))).alias(name) for name in picks]))
    return out.select(*[F.col("__g")[k].alias(k) for k in keys], "n", *picks)


#: Equal parts that a round of counted() cuts a large group's range into, rounds at most, and groups to broadcast at most.
BINS, ROUNDS, LOOKUP_GROUPS = 1024, 6, 100_000


def _attached(groups: DataFrame, count: int) -> DataFrame:
    return F.broadcast(groups) if count <= LOOKUP_GROUPS else groups


def ends(rows: DataFrame) -> list[Column]:
    """Ends of a group's finite values, halved so that their distance is finite too."""
    if not isinstance(rows.schema["__v"].dataType, NumericType):
        return [F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi")]
    half = F.col("__v").cast("double") / 2
    finite = F.when(F.abs(half) < float("inf"), half)
    return [F.min(finite).alias("__lo"), F.max(finite).alias("__hi")]


def counted(rows: DataFrame, wanted: DataFrame, groups: int, rounds: int = ROUNDS) -> DataFrame:
    """(__i, rank, __v): the values at the wanted (__i, rank) of numbered groups, of rows (__i, __lo and __hi of the
    group, __v), each of which counts __c times.

    Each group's range is cut into BINS equal parts and the values of each part are counted, which tasks do for
    themselves before anything is dealt; a rank lies in one part, and only the parts with a wanted rank go on: as
    counts of equal values where these are few, and else in a further round over their own, narrower range. Parts that
    do not get narrower (many values that differ by less than a double tells) come from a range sort."""
    if not isinstance(rows.schema["__v"].dataType, NumericType) or not rounds:
        return _sorted_ranks(rows, wanted, groups)
    binned = rows.select((F.col("__i") * (2 * BINS) + _part()).alias("__p"), "__v", "__c")  # group and part in one number
    counts = cut(binned.groupBy("__p").agg(F.sum("__c").alias("c")), "bins")  # BINS + 3 of a group at most
    at = _held(counts, wanted)
    kept = binned.join(_attached(at.select("__p").distinct(), groups), "__p")
    kept = cut(kept.groupBy("__p", "__v").agg(F.sum("__c").alias("__c")), "parts")
    return _within(kept, at, groups, rounds)


def _part() -> Column:
    """The part (from 0) of a value's group that holds it; what is not finite has parts of its own at the ends."""
    half, width = F.col("__v").cast("double") / 2, F.col("__hi") - F.col("__lo")
    inside = F.when(width > 0, F.least(F.floor((half - F.col("__lo")) / width * BINS).cast("int"), F.lit(BINS - 1))).otherwise(F.lit(0))
    return F.when(F.isnan(half), F.lit(BINS + 1)).when(half == float("inf"), F.lit(BINS)).when(half == -float("inf"), F.lit(-1)).otherwise(inside) + 1


def _held(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(__i, rank, __p, __at): the part of each wanted rank, and the rank within it."""
    counts = counts.withColumn("__i", F.floor(F.col("__p") / (2 * BINS)))
    spans = counts.withColumn("__before", F.sum("c").over(Window.partitionBy("__i").orderBy("__p")) - F.col("c"))
    held = (F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("c"))
    return cut(wanted.join(spans, "__i").where(held).select("__i", "rank", "__p", (F.col("rank") - F.col("__before")).alias("__at")), "places")


def _within(kept: DataFrame, at: DataFrame, groups: int, rounds: int) -> DataFrame:
    """(__i, rank, __v) from the counted values (__p, __v, __c) of the parts that hold a wanted rank."""
    sizes = cut(kept.groupBy("__p").agg(F.count(F.lit(1)).alias("k"), *ends(kept)), "sizes")
    many = cut(sizes.where(F.col("k") > max(GATHERED, 1)).withColumn("__i", F.monotonically_increasing_id()), "large")
    left = many.count()
    few = kept.join(_attached(many.select("__p"), left), "__p", "left_anti") if left else kept
    few = few.withColumn("__to", F.sum("__c").over(Window.partitionBy("__p").orderBy("__v")))
    found = at.join(few, "__p").where((F.col("__at") < F.col("__to")) & (F.col("__at") >= F.col("__to") - F.col("__c"))).select("__i", "rank", "__v")
    if left:
        ahead = at.join(many.select("__p", F.col("__i").alias("__n")), "__p")
        own = kept.join(_attached(many.select("__p", "__i", "__lo", "__hi"), left), "__p").drop("__p")
        deeper = counted(own, ahead.select(F.col("__n").alias("__i"), F.col("__at").alias("rank")).distinct(), left, rounds - 1)
        deeper = deeper.select(F.col("__i").alias("__n"), F.col("rank").alias("__at"), "__v")
        found = found.unionByName(ahead.join(deeper, ["__n", "__at"]).select("__i", "rank", "__v"))
    return found


def _sorted_ranks(rows: DataFrame, wanted: DataFrame, groups: int) -> DataFrame:
    """The same by a range sort of the groups' rows, for values of any kind."""
    table = running(rows.select("__i", "__v", "__c"), [F.col("__i"), F.col("__v")], ["__c"])
    table = cut(table.select("__i", "__v", "__c", F.col("cum___c").alias("__to")), "sums")
    starts = cut(table.groupBy("__i").agg(F.min(F.col("__to") - F.col("__c")).alias("__start")), "starts")
    asked = wanted.join(starts, "__i").select("__i", "rank", (F.col("__start") + F.col("rank")).alias("__at"))
    found = table.join(_attached(asked, groups), "__i")
    return found.where((F.col("__at") < F.col("__to")) & (F.col("__at") >= F.col("__to") - F.col("__c"))).select("__i", "rank", "__v")


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, names): exact quantiles of each group, linear between the two nearest values."""
    picks = {}
    for name, p in points.items():
        place = (F.col("n") - 1) * F.lit(p)
        picks |= {f"__lo_{name}": F.floor(place), f"__hi_{name}": F.ceil(place)}
    found = at_ranks(df, keys, value, picks)
    part = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    between = {name: F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * part(p) for name, p in points.items()}
    return found.select(*keys, "n", *[c.alias(name) for name, c in between.items()])


def union_quantiles(rows: DataFrame, unions: DataFrame, points: dict[str, float]) -> DataFrame:
    """(__i, names): exact quantiles, as of quantiles(), of numbered unions of groups that may overlap. unions has (__i, __g);
    rows has (__g, __v), and __lo and __hi, the same for all groups that meet in a union: ends (halved) of their values.

    A value is counted in its group only, whatever the number of unions; these add up counts of parts, and only values of
    parts with a wanted rank go on."""
    many = unions.count()
    binned = rows.where(F.col("__v").isNotNull()).select((F.col("__g") * (2 * BINS) + _part()).alias("__q"), "__v")
    counts = cut(binned.groupBy("__q").agg(F.count(F.lit(1)).alias("c")), "bins")  # BINS + 3 of a group at most
    counts = counts.select(F.floor(F.col("__q") / (2 * BINS)).alias("__g"), (F.col("__q") % (2 * BINS)).alias("__b"), "c").join(unions, "__g")
    counts = cut(counts.groupBy((F.col("__i") * (2 * BINS) + F.col("__b")).alias("__p")).agg(F.sum("c").alias("c")), "unions")
    sizes = cut(counts.groupBy(F.floor(F.col("__p") / (2 * BINS)).alias("__i")).agg(F.sum("c").alias("n")), "sizes")
    picks = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(p)).alias("place")) for name, p in points.items()])
    asked = sizes.select("__i", F.explode(picks).alias("__k")).select("__i", "__k.*").withColumns({"__below": F.floor("place"), "__above": F.ceil("place")})
    at = _held(counts, asked.select("__i", F.explode(F.array("__below", "__above")).alias("rank")).distinct())
    parts = at.select("__i", "__p", (F.col("__p") % (2 * BINS)).alias("__b")).distinct().join(unions, "__i")
    parts = cut(parts.select("__p", (F.col("__g") * (2 * BINS) + F.col("__b")).alias("__q")), "lookup")
    kept = cut(binned.join(_attached(parts, 2 * many * len(points)), "__q").groupBy("__p", "__v").agg(F.count(F.lit(1)).alias("__c")), "parts")
    values = cut(_within(kept, at, many, ROUNDS), "values")  # two for each union and point at most
    for side in ("__below", "__above"):
        asked = asked.join(values.select("__i", F.col("rank").alias(side), F.col("__v").alias(f"{side}_v")), ["__i", side])
    between = F.col("__below_v") + (F.col("__above_v") - F.col("__below_v")) * (F.col("place") - F.floor("place"))
    return asked.groupBy("__i").agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in points])
