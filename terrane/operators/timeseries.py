"""Windows relative to each row's date, as-of features, calendars of months and fall-back indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terrane.operators import ranks
from terrane.session import cut


def day_number(date: Column | str) -> Column:
    return F.unix_date(F.to_date(date))


def month_number(date: Column | str) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def day_frame(keys: list[str], day: str, low: int, high: int) -> Window:
    """Rows of the same keys whose day lies `low` to `high` days from the row's own, both included."""
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(low, high)


def rolling(value: Column | str, frame: Window) -> tuple[Column, Column]:
    """Exact median and count of the values in a frame."""
    return F.percentile(value, 0.5).over(frame), F.count(value).over(frame)


#: Rows of one key from which on its frames are worked out by themselves instead of with other keys, and from which on by
#: blocks of days; rows of a group of keys, about, and values of its frames that are sorted at once.
HOT_ROWS, BLOCK_ROWS, GROUP_ROWS, SORTED = 10_000, 1_000_000, 100_000, 1 << 20


def rolling_stats(df: DataFrame, keys: list[str], day: str, value: str, frames: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int]] | None = None, since: str | None = None, asked: str | None = None) -> DataFrame:
    """Adds <name>_median and <name>_n for each frame of days, and <name>_n alone for those of `counts`. Rows with a null
    key get null and 0. With `since`, that column is days_since_previous. With `asked`, only rows with this flag come out;
    the others lend their days and values.

    Keys of few rows are dealt in groups, and a task sorts the frames of a group's days in blocks. A key of more than HOT_ROWS is a
    task's own; one of more than BLOCK_ROWS is cut into blocks of days: each value goes to the blocks whose days see it in
    some frame, so one key spreads over tasks. Frames depend on key and day alone, so a block selects one median for each
    of its days, whatever the number of its rows, and rows take theirs by key and day."""
    few, many, found = _stats_by_size(df, keys, day, value, frames, counts or {}, since, asked)
    return few if found is None else few.unionByName(many.join(found, [*keys, day]).select(*few.columns))


def daily_stats(df: DataFrame, keys: list[str], day: str, value: str, frames: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int]] | None = None, since: str | None = None, asked: str | None = None) -> DataFrame:
    """(keys, day, statistics of rolling_stats), once for each key and day, null ones among them."""
    df = df.select(*keys, day, value, *([asked] if asked else []))
    few, _, found = _stats_by_size(df, keys, day, value, frames, counts or {}, since, asked)
    few = few.drop(value, *([asked] if asked else [])).distinct()
    return few if found is None else few.unionByName(found.select(*few.columns))


def _stats_by_size(df: DataFrame, keys: list[str], day: str, value: str, frames: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int]], since: str | None, asked: str | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of keys of few rows with their statistics, the other rows, and the statistics of these by key and day."""
    hot = cut(df.where(_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select(*keys, (F.col("__n") <= BLOCK_ROWS).alias("__whole")), "hot")
    if hot.isEmpty():
        return _windowed_stats(df, keys, day, value, frames, counts, since, asked), None, None
    split = df.join(hot, keys, "left").select(*df.columns, "__whole", (F.col("__whole").isNotNull() & F.col(day).isNotNull()).alias("__hot"))
    few = _windowed_stats(split.where("not __hot").drop("__hot", "__whole"), keys, day, value, frames, counts, since, asked)
    many = split.where("__hot").drop("__hot")
    found = _blocked_stats(many, keys, day, value, frames, counts, since, asked)
    return few, many.where(asked) if asked else many, found


def _known(keys: list[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def _windowed_stats(df: DataFrame, keys: list[str], day: str, value: str, frames: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int]], since: str | None, asked: str | None) -> DataFrame:
    """Keys of few rows, whole keys together in groups of about GROUP_ROWS rows. A null day sees the null days of its key."""
    count = df.count()
    groups = max(1, -(-count // GROUP_ROWS))
    # rows without a key see nothing and are dealt by what they hold
    group = F.pmod(F.when(_known(keys), F.xxhash64(*keys)).otherwise(F.xxhash64(day, value)), F.lit(groups))
    fields = [T.StructField(f"{name}_{what}", T.DoubleType() if what == "median" else T.LongType()) for name in frames | counts for what in (("median", "n") if name in frames else ("n",))]
    fields += [T.StructField(since, df.schema[day].dataType)] if since else []
    rows = df.select("*", F.col(day).cast("long").alias("__at"), F.col(value).cast("double").alias("__v"), group.alias("__group"))

    def run(table: pa.Table) -> pa.Table:
        known, codes = np.ones(len(table), dtype=bool), np.zeros(len(table), dtype=np.int64)
        for key in keys:
            column = table.column(key).combine_chunks().dictionary_encode()
            known &= ~column.is_null().to_numpy(zero_copy_only=False)
            codes = codes * (len(column.dictionary) + 1) + column.indices.fill_null(len(column.dictionary)).to_numpy()
            codes = np.unique(codes, return_inverse=True)[1]
        undated, valued = (table.column(c).is_null().to_numpy() for c in ("__at", "__v"))
        at, v, valued = table.column("__at").fill_null(0).to_numpy(), table.column("__v").fill_null(0.0).to_numpy(), ~valued
        out = table.drop_columns(["__at", "__v", "__group"])
        wanted = None
        if asked:
            wanted = table.column(asked).fill_null(False).to_numpy()
            out, known = out.filter(pa.array(wanted)), known[wanted]
        found = frame_stats(codes * 2 + undated, np.where(undated, 0, at), v, valued, undated, frames, counts, since, wanted)
        for field in fields:
            values, missing = found[field.name]
            if field.name == since:
                own = pa.array(values, mask=missing | ~known).cast(arrow_type)
            else:
                own = pa.array(values, mask=missing | ~known) if field.name.endswith("_median") else pa.array(np.where(known, values, 0))
            out = out.append_column(field.name, own)
        return out

    if count == 0:
        return df.where(F.lit(False)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    arrow_type = to_arrow_type(df.schema[day].dataType)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // 4))  # what a task sorts stays bounded
    out = rows.repartition(tasks, "__group").groupBy("__group").applyInArrow(run, T.StructType([*df.schema.fields, *fields]))
    if not since:
        return out
    # Rows without a key are not dealt by it; the previous day of the same nulls is found among their days.
    days = df.where(~_known(keys)).select(*keys, day).distinct()
    alone = cut(days.select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, day)], (F.col(day) - F.lag(day).over(Window.partitionBy(*keys).orderBy(day))).alias("__since")), "alone")
    if alone.isEmpty():
        return out
    same = F.lit(True)
    for c in (*keys, day):
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return out.join(alone, same, "left").select(*df.columns, *[f.name for f in fields if f.name != since], F.coalesce(since, "__since").alias(since))


def frame_stats(codes: np.ndarray, at: np.ndarray, v: np.ndarray, valued: np.ndarray, undated: np.ndarray, frames: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int]], since: str | None = None, wanted: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """<name>_n and <name>_median of each row's (or each wanted row's) frames over the values of its code, and the days since its
    previous day, each with what is null."""
    # One number for code and day, codes so far apart that no frame reaches the next one.
    dated = at[~undated]
    low, high = (int(dated.min()), int(dated.max())) if len(dated) else (0, 0)
    reach = max(abs(x) for frame in (frames | counts).values() for x in frame)
    span = high - low + 2 * reach + 1
    place = codes * span + np.where(undated, reach, at - low + reach)
    taken = slice(None) if wanted is None else wanted
    asked, first_row, back = np.unique(place[taken], return_index=True, return_inverse=True)
    moves = ~undated[taken][first_row]
    order = np.argsort(place[valued], kind="stable")
    held, values = place[valued][order], v[valued][order]
    out: dict[str, tuple[np.ndarray, np.ndarray | None]] = {}
    for name, (start, stop) in (frames | counts).items():
        first, last = np.searchsorted(held, asked + start * moves, "left"), np.searchsorted(held, asked + stop * moves, "right")
        n = np.maximum(last - first, 0)
        out[f"{name}_n"] = n[back], None
        if name in frames:
            out[f"{name}_median"] = medians(values, first, n)[back], (n == 0)[back]
    if since:
        days = asked if wanted is None else np.unique(place)
        before = np.searchsorted(days, asked, "left") - 1
        gap = asked - days[before] if len(days) else asked
        none = (before < 0) | ~moves | (asked // span != days[before] // span if len(days) else False)
        out[since] = np.where(none, 0, gap)[back], none[back]
    return out


def medians(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of the n values from each `first` on, those of like n together, SORTED values at once."""
    out, order = np.full(len(n), np.nan), np.argsort(n, kind="stable")
    start = int(np.searchsorted(n[order], 1))
    while start < len(order):
        stop = min(len(order), start + max(1, SORTED // int(n[order[start]])))
        stop = max(start + 1, min(stop, int(np.searchsorted(n[order], 2 * n[order[start]], "right")), start + max(1, SORTED // int(n[order[stop - 1]]))))
        some = order[start:stop]
        width = int(n[some].max())
        places = np.minimum(first[some][:, None] + np.arange(width), len(values) - 1)
        block = np.where(np.arange(width) < n[some][:, None], values[places], np.nan)
        block.sort(axis=1)  # what is beyond a frame comes last, as NaN
        row = np.arange(len(some))
        below, above = block[row, (n[some] - 1) // 2], block[row, n[some] // 2]
        with np.errstate(invalid="ignore"):  # both infinities
            out[some] = np.where(below == above, below, below * 0.5 + above * 0.5)
        start = stop
    return out


def _blocked_stats(df: DataFrame, keys: list[str], day: str, value: str, frames: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int]], since: str | None, asked: str | None) -> DataFrame:
    """(keys, day, statistics) of each key and day; keys with the flag __whole are one block."""
    every = frames | counts
    span = max(1, (max(h for _, h in every.values()) - min(lo for lo, _ in every.values()) + 1) // 2)
    block = lambda at: F.floor(at / F.lit(span)).cast("long")
    seen = F.array_distinct(F.flatten(F.array(F.array(block(F.col(day))), *[F.sequence(block(F.col(day) - high), block(F.col(day) - low)) for low, high in every.values()])))
    seen = F.when(F.col("__whole"), F.array(F.lit(None).cast("long"))).otherwise(seen)
    values = df.select(*keys, F.explode(seen).alias("__block"), F.col(day).cast("long").alias("__at"), F.col(value).cast("double").alias("__v"), F.coalesce(F.col(asked), F.lit(False)).alias("__asked") if asked else F.lit(True).alias("__asked"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    packed = values.mapInArrow(pack_values([*keys, "__block"]), f"{kinds}, __block long, __packed binary")
    named = [f"{name}_{what}" for name in every for what in (("median", "n") if name in frames else ("n",))]
    schema = ", ".join([kinds, "__at long, __asked boolean", *[f"{c} {'double' if c.endswith('_median') else 'long'}" for c in named]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), np.dtype(PACKED)) for x in table.column("__packed")])
        rows = rows[np.argsort(rows["at"], kind="stable")]
        days = np.unique(rows["at"])
        own = key[-1].as_py()
        days = days if own is None else days[days // span == own]  # those of the block
        wanted = np.isin(days, rows["at"][rows["asked"]])
        at, v = rows["at"][rows["valued"]], rows["v"][rows["valued"]]
        out = {k: pa.repeat(x, len(days)) for k, x in zip(keys, key[:-1], strict=True)} | {"__at": pa.array(days), "__asked": pa.array(wanted)}
        ends = {name: [np.searchsorted(at, days[wanted] + low, "left"), np.searchsorted(at, days[wanted] + high, "right")] for name, (low, high) in every.items()}
        pairs = np.array([ends[name] for name in frames], np.int64).reshape(len(frames), 2, -1).swapaxes(0, 1).reshape(2, -1)
        some, back = np.unique(pairs, axis=1, return_inverse=True)  # frames of like width meet the same values on other days
        found = window_medians(v, *some)[back.reshape(-1)].reshape(len(frames), -1)
        for i, (name, (first, last)) in enumerate(ends.items()):
            n = np.zeros(len(days), np.int64)
            n[wanted] = last - first
            if name in frames:
                m = np.zeros(len(days))
                m[wanted] = found[i]
                out[f"{name}_median"] = pa.array(m, mask=n == 0)
            out[f"{name}_n"] = pa.array(n)
        return pa.table(out)

    found = packed.groupBy(*keys, "__block").applyInArrow(run, schema)
    if since:
        found = found.withColumn(since, (F.col("__at") - F.lag("__at").over(Window.partitionBy(*keys).orderBy("__at"))).cast(df.schema[day].dataType))
    return found.where("__asked").withColumn(day, F.col("__at").cast(df.schema[day].dataType)).drop("__at", "__asked")


#: A packed row, and rows that are packed at once, about.
PACKED, PACKED_ROWS = [("at", np.int64), ("v", np.float64), ("valued", np.bool_), ("asked", np.bool_)], 1 << 18


def pack_values(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of like keys as one array of their days and values, so that few, long rows are shuffled."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        codes = np.zeros(len(table), dtype=np.int64)
        for key in keys:
            column = table.column(key).combine_chunks().dictionary_encode()
            codes = codes * (len(column.dictionary) + 1) + column.indices.fill_null(len(column.dictionary)).to_numpy()
            codes = np.unique(codes, return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        rows = np.empty(len(table), np.dtype(PACKED))
        rows["at"], rows["asked"] = table.column("__at").to_numpy()[order], table.column("__asked").to_numpy()[order]
        rows["v"], rows["valued"] = table.column("__v").fill_null(0.0).to_numpy()[order], ~table.column("__v").is_null().to_numpy()[order]
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        of = table.select(keys).take(pa.array(order[starts])).combine_chunks()
        arrays = pa.array([part.tobytes() for part in np.split(rows, starts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([*(of.column(k).combine_chunks() for k in keys), arrays], [*keys, "__packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def window_medians(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Medians of the values from each `first` to before its `last`, NaN for none; NaN values are the largest. Values are cut by rank
    into parts, counts of parts tell which one holds a median, and only its values are looked at."""
    n, out = np.maximum(last - first, 0), np.full(len(first), np.nan)
    if not n.any():
        return out
    size = max(512, len(v) // 1024)
    order = np.argsort(v, kind="stable")
    part = np.empty(len(v), np.int64)
    part[order] = np.arange(len(v)) // size
    parts = int(part.max()) + 1
    cuts = np.unique(np.concatenate([first, last]))
    piece = np.searchsorted(cuts, np.arange(len(v)), "right")
    before = np.bincount(piece * parts + part, minlength=(len(cuts) + 1) * parts).astype(np.int32).reshape(-1, parts).cumsum(axis=0)  # values before each cut, of each part
    for k in np.flatnonzero(n).tolist():
        a, b = int(first[k]), int(last[k])
        upto = np.cumsum(before[np.searchsorted(cuts, b)] - before[np.searchsorted(cuts, a)])
        ends = []
        for rank in ((n[k] - 1) // 2, n[k] // 2):
            at = int(np.searchsorted(upto, rank, "right"))
            held = order[at * size : (at + 1) * size]
            ends.append(v[held[(held >= a) & (held < b)][rank - (upto[at - 1] if at else 0)]])
        with np.errstate(invalid="ignore"):  # both infinities
            out[k] = ends[0] if ends[0] == ends[1] else ends[0] * 0.5 + ends[1] * 0.5
    return out


def days_since_previous(keys: list[str], day: str) -> Column:
    """Days since the latest strictly earlier row of the same keys."""
    return F.col(day) - F.max(day).over(Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, value: str) -> DataFrame:
    """Adds to left the latest right value of the same keys dated strictly before the left row."""
    both = left.withColumns({"__day": F.col(left_day), "__value": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(True)}).unionByName(
        right.select(*keys, F.col(right_day).alias("__day"), F.col(value).alias("__value"), F.lit(False).alias("__left")), allowMissingColumns=True
    )
    frame = Window.partitionBy(*keys).orderBy("__day").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(~F.col("__left"), F.struct("__day", "__value"))).over(frame)["__value"]
    return both.withColumn(f"previous_{value}", latest).where("__left").drop("__day", "__value", "__left")


def month_index(sales: DataFrame, segment: str, pool: str, month: str, value: str, first: int, last: int, min_sales: int, widths: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """(segment, month, value, source): median of the months strictly before, of the segment in the narrowest window
    with enough sales, else of its pool, else the last value carried on.

    Monthly counts choose the window of each segment and month first; a sale is then counted in its month, and windows
    add up the counts of their months. The values of a month have the range of their segment or pool.
    """
    months = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("__m")
    grid = sales.select(segment, pool).distinct().select(segment, pool, months)
    chosen, groups = F.when(F.lit(False), F.lit(None).cast("string")), []
    for name, key in (("segment", segment), ("pooled", pool)):
        valued = sales.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(month).alias("__s"), F.col(value).alias("__v"))
        monthly = cut(valued.groupBy(key, "__s").agg(F.count(F.lit(1)).alias("__c"), *ranks.ends(valued)), "monthly")  # keys times months
        groups.append(monthly.select(F.lit(name).alias("level"), F.col(key).cast("string").alias("key"), "__s", "__lo", "__hi"))
        monthly = monthly.select(key, "__c", (F.explode(F.sequence(F.lit(1), F.lit(max(widths))))).alias("__age"), "__s").withColumn("__m", F.col("__s") + F.col("__age"))
        own = monthly.groupBy(key, "__m").agg(*[F.sum(F.when(F.col("__age") <= w, F.col("__c"))).alias(f"__{name}_{w}") for w in widths])
        grid = grid.join(own, [key, "__m"], "left")
        for w in widths:
            chosen = chosen.when(F.col(f"__{name}_{w}") >= min_sales, F.lit(f"{name}_{w}"))
    grid = cut(grid.select(segment, pool, "__m", chosen.alias("__source")), "grid")
    level, width = F.substring_index("__source", "_", 1), F.substring_index("__source", "_", -1).cast("int")
    cell = F.struct(level.alias("level"), F.when(level == "segment", F.col(segment).cast("string")).otherwise(F.col(pool).cast("string")).alias("key"), F.col("__m").alias("m"))
    cells = cut(grid.where("__source is not null").select(cell.alias("cell"), width.alias("w")).distinct().withColumn("__i", F.monotonically_increasing_id()), "cells")  # segments times months
    # The months of each cell's window, and those that some window holds, so that a sale meets only these.
    spans = cut(cells.select("__i", "cell.level", "cell.key", F.explode(F.sequence(F.col("cell.m") - F.col("w"), F.col("cell.m") - 1)).alias("__s")), "spans")
    whole = Window.partitionBy("level", "key")
    groups = groups[0].unionByName(groups[1]).groupBy("level", "key", "__s").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    groups = groups.withColumns({"__lo": F.min("__lo").over(whole), "__hi": F.max("__hi").over(whole)}).join(spans, ["level", "key", "__s"], "left_semi")
    groups = cut(groups.withColumn("__g", F.monotonically_increasing_id()), "months")
    levels = F.explode(F.array(*[F.struct(F.lit(name).alias("level"), F.col(key).cast("string").alias("key")) for name, key in (("segment", segment), ("pooled", pool))])).alias("__l")
    rows = sales.select(F.col(month).alias("__s"), F.col(value).alias("__v"), levels).select("__l.level", "__l.key", "__s", "__v").join(groups, ["level", "key", "__s"]).select("__g", "__lo", "__hi", "__v")
    unions = cut(spans.join(groups, ["level", "key", "__s"]).select("__i", "__g"), "windows")
    medians = ranks.union_quantiles(rows, unions, {"__own": 0.5}).join(cells, "__i").select("cell", "__own")
    rows = grid.withColumn("cell", F.when(F.col("__source").isNotNull(), cell)).join(medians, "cell", "left").select(segment, F.col("__m").alias("month"), "__own", "__source")
    before = Window.partitionBy(segment).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("__own", ignorenulls=True).over(before)
    source = F.coalesce("__source", F.when(carried.isNotNull(), F.lit("carried")))
    return rows.select(segment, "month", carried.alias("value"), source.alias("source"))


#: Rows and intervals of a task that looks up intervals, about, whatever the number of shuffle partitions.
TASK_ROWS = 200_000
#: Columns of interval_features that every row gets.
INTERVAL_FEATURES = {"n_open": "long", "n_kinds": "long", "days_to_next": "int", "n_ended": "long"}


def interval_features(rows: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, kind: str, kinds: list[str] | None = None, recent: int = 730) -> DataFrame:
    """Adds to rows, as of their day: n_open (intervals of the key with start <= at < end), n_kinds (kinds among these),
    days_to_next (until the first of these ends), n_ended (ended in the `recent` days up to the day), and with `kinds`
    open_<kind> for each. Rows with a null key or day, and keys without intervals, get zeros and null.

    All depends on key and day alone, so distinct days of a key are asked, and rows take their answers by key and day. A
    key of few days and intervals is joined and aggregated; one with more than HOT_ROWS of either is cut into years: an
    interval goes to the years in which it is open or recently ended, and a task answers the days of one year."""
    given = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    given = given.select(F.col(key).alias("__k"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), F.col(kind).alias("__kind"))
    asked = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__k"), F.col(at).cast("long").alias("__at")).distinct()
    given, asked = cut(given, "intervals"), cut(asked, "asked")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(given.count() + rows.count()) // TASK_ROWS))
    names = kinds or []
    columns = INTERVAL_FEATURES | {f"open_{name}": "long" for name in names}
    heavy = lambda df: df.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select("__k")
    hot = cut(heavy(asked).unionByName(heavy(given)).distinct(), "hot")
    none = hot.isEmpty()

    is_open = (F.col("__s") <= F.col("__at")) & (F.col("__e") > F.col("__at"))
    ended = (F.col("__e") <= F.col("__at")) & (F.col("__e") > F.col("__at") - recent)
    left = asked if none else asked.join(hot, "__k", "left_anti")
    found = left.repartition(tasks, "__k").join(given.repartition(tasks, "__k"), "__k").groupBy("__k", "__at").agg(
        F.count_if(is_open).alias("n_open"),
        F.count_distinct(F.when(is_open, F.col("__kind"))).alias("n_kinds"),
        F.min(F.when(is_open, F.col("__e") - F.col("__at"))).cast("int").alias("days_to_next"),
        F.count_if(ended).alias("n_ended"),
        *[F.count_if(is_open & (F.col("__kind") == name)).alias(f"open_{name}") for name in names],
    )
    if not none:
        found = found.unionByName(_intervals_by_year(asked.join(hot, "__k", "left_semi"), given.join(hot, "__k", "left_semi"), names, columns, recent))
    answers = found.withColumnsRenamed({c: f"__r_{c}" for c in columns} | {"__k": "__r_k", "__at": "__r_at"}).repartition(tasks, "__r_k", "__r_at")
    out = rows.withColumns({"__k": F.col(key), "__at": F.col(at).cast("long")}).repartition(tasks, "__k", "__at")
    out = out.join(answers, (F.col("__k") == F.col("__r_k")) & (F.col("__at") == F.col("__r_at")), "left")
    filled = [(F.col(f"__r_{c}") if c == "days_to_next" else F.coalesce(F.col(f"__r_{c}"), F.lit(0))).cast(t).alias(c) for c, t in columns.items()]
    return out.select(*rows.columns, *filled)


def _intervals_by_year(asked: DataFrame, given: DataFrame, names: list[str], columns: dict[str, str], recent: int) -> DataFrame:
    year = lambda day: F.floor(day / F.lit(366)).cast("long")
    days = asked.groupBy("__k").agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"))  # one row for each hot key
    given = given.join(days, "__k").where((F.col("__s") <= F.col("__high")) & (F.col("__e") + recent > F.col("__low")) & (F.col("__s") < F.col("__e")) | F.col("__e").between(F.col("__low") - recent, F.col("__high")))
    first, last = F.greatest(F.least("__s", "__e"), F.col("__low")), F.least(F.greatest("__s", "__e") + recent, F.col("__high"))
    spread = given.select("__k", F.explode(F.sequence(year(first), F.greatest(year(first), year(last)))).alias("__year"), F.lit(None).cast("long").alias("__at"), "__s", "__e", F.col("__kind").cast("string").alias("__kind"))
    own = asked.select("__k", year(F.col("__at")).alias("__year"), "__at", *[F.lit(None).cast("long").alias(c) for c in ("__s", "__e")], F.lit(None).cast("string").alias("__kind"))
    schema = f"__k {asked.schema['__k'].dataType.simpleString()}, __at long, " + ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known = table.filter(table.column("__at").is_null())
        days = np.unique(table.column("__at").drop_null().to_numpy())
        begin, stop = known.column("__s").to_numpy(), known.column("__e").to_numpy()
        codes = known.column("__kind").combine_chunks().dictionary_encode()
        values = codes.dictionary.to_pylist()
        code = codes.indices.fill_null(len(values)).to_numpy()
        out = []
        for day in days.tolist():
            is_open = (begin <= day) & (stop > day)
            by_kind = np.bincount(code[is_open], minlength=len(values) + 1)
            ended = np.count_nonzero((stop <= day) & (stop > day - recent))
            n = int(is_open.sum())
            own = {name: int(by_kind[values.index(name)]) if name in values else 0 for name in names}
            out.append({"n_open": n, "n_kinds": int(np.count_nonzero(by_kind[: len(values)])), "days_to_next": int(stop[is_open].min()) - day if n else None, "n_ended": ended} | {f"open_{k}": v for k, v in own.items()})
        arrays = {"__k": pa.repeat(key[0], len(days)), "__at": pa.array(days, pa.int64())}
        return pa.table(arrays | {c: pa.array([o[c] for o in out], pa.int32() if t == "int" else pa.int64()) for c, t in columns.items()})

    return spread.unionByName(own).groupBy("__k", "__year").applyInArrow(run, schema)
