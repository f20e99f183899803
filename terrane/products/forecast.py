"""Growth forecasts: date-relative bases and targets, walk-forward folds, baselines, gates, and a serving snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.wording import driver_lines
from terrane.operators import boosting, contributions, evaluation, folds, learning, timeseries
from terrane.session import cut

#: Fixed frames, in days from the row: base, and one target per horizon.
BASE = (-92, -1)
HORIZONS = {"3m": (76, 107), "1y": (335, 396), "3y": (1065, 1126)}
LAGS = {"3m": 91, "1y": 365, "3y": 1096}
MIN_SALES = 5
#: Features that a forecast is explained by at most, and the contribution of each at least.
DRIVERS, LEAST_DRIVER = 3, 0.001
DRIVER_NAMES = {"momentum_3m": "momentum of three months", "momentum_1y": "momentum of a year", "building_year": "sales in the building", "area_year": "sales in the area", "building_since": "days since a sale in the building", "area_since": "days since a sale in the area", "log_base": "price level"}


#: All frames, those of the base at the lags among them, and the days that are counted only.
FRAMES = {"base": BASE} | {f"ahead_{h}": w for h, w in HORIZONS.items()} | {f"lag_{h}": (BASE[0] - lag, BASE[1] - lag) for h, lag in LAGS.items()}
YEAR = (-365, -1)


def keys(sales: DataFrame) -> DataFrame:
    """Adds the building, area and city keys (null if a part is null) and the day number."""
    part = lambda *c: F.when(reduce(and_, [F.col(x).isNotNull() for x in c]), F.concat_ws("|", *c))
    return sales.withColumns({"building_key": part("area", "building", "kind"), "area_key": part("area", "kind"), "city_key": F.col("kind"), "day": timeseries.day_number("date"), "ppsm": F.col("price") / F.col("size")})


def dataset(sales: DataFrame, asked: str | None = None) -> DataFrame:
    """Sales with base, targets, statuses, momentum and activity; rows of null value (requests) get the features only.
    With `asked`, only rows with this flag come out, and without targets; the others are their history.

    All frames of a building share one shuffle; those of an area are worked out once for each of its days. Features use
    rows strictly before the row's own day.
    """
    given = keys(sales) if "day" not in sales.columns else sales
    enough = lambda level: {f"{level}_{n}": F.when(F.col(f"{level}_{n}_n") >= MIN_SALES, F.col(f"{level}_{n}_median")) for n in FRAMES}
    levels = {level: ([f"{level}_key"], "day", "ppsm", {f"{level}_{n}": w for n, w in FRAMES.items()}, {f"{level}_year": YEAR}, f"{level}_since", asked) for level in ("building", "area")}
    area = timeseries.daily_stats(given, *levels["area"]).withColumns(enough("area")).withColumnsRenamed({"area_year_n": "area_year", "area_key": "__area", "day": "__day"})
    area = cut(area.select("__area", "__day", "area_year", "area_since", *enough("area")), "areas")  # areas times days
    rows = timeseries.rolling_stats(given, *levels["building"]).withColumns(enough("building") | {"own": F.col("building_base_n") >= MIN_SALES}).withColumnRenamed("building_year_n", "building_year")
    rows = rows.select(*given.columns, "building_year", "building_since", "own", *enough("building"))
    rows = rows.join(area, F.col("area_key").eqNullSafe(F.col("__area")) & F.col("day").eqNullSafe(F.col("__day")), "left")
    of = lambda name: F.when(F.col("own"), F.col(f"building_{name}")).otherwise(F.col(f"area_{name}"))
    rows = rows.withColumns({"level": F.when(F.col("own"), "building").otherwise("area"), "base": of("base")})
    rows = rows.withColumns({f"momentum_{h}": F.ln(F.col("base") / of(f"lag_{h}")) for h in HORIZONS})
    if not asked:
        rows = rows.join(F.broadcast(given.where("ppsm is not null").agg(F.max("day").alias("__end"))))
        for h, (_, stop) in HORIZONS.items():
            ahead = of(f"ahead_{h}")
            status = F.when(F.col("base").isNull(), "no_base").when(F.col("day") + stop > F.col("__end"), "window_open").when(ahead.isNull(), "no_target").otherwise("usable")
            rows = rows.withColumns({f"status_{h}": status, f"growth_{h}": F.when(status == "usable", F.ln(ahead / F.col("base")))})
    return rows.drop("__area", "__day", "__end", "own", *enough("building"), *enough("area"))


FEATURES = ["momentum_3m", "momentum_1y", "building_year", "area_year", "building_since", "area_since", "log_base"]


@dataclass
class Forecaster:
    """fit(sales) trains a model per horizon whose gate passes; forecast(requests) gives growth or not_deployed."""

    folds: int = 3
    step: int = 90
    models: dict[str, object] = field(default_factory=dict)
    reasons: dict[str, list[str]] = field(default_factory=dict)
    sales: DataFrame | None = None

    def fit(self, sales: DataFrame) -> Forecaster:
        self.sales = sales
        rows = dataset(cut(keys(sales).select("building_key", "area_key", "day", "ppsm"), "keyed")).withColumn("log_base", F.ln("base"))
        rows = cut(rows.select("day", *dict.fromkeys([*FEATURES, *[f"{x}_{h}" for h in HORIZONS for x in ("status", "growth", "momentum")]])), "forecast")
        known = {h: rows.where(F.col(f"status_{h}") == "usable") for h in HORIZONS}
        last = rows.agg(*[F.max(F.when(F.col(f"status_{h}") == "usable", F.col("day"))).alias(h) for h in HORIZONS]).first()
        periods = {h: folds.fold_table(rows.sparkSession, last[h], self.step, self.folds, self.step).collect() for h in HORIZONS if last[h] is not None}
        # Training rows see their whole horizon before the test starts, as in folds.roles. The last model is of all rows.
        fits = {(h, p.fold): (f"growth_{h}", p.start - HORIZONS[h][1]) for h in periods for p in periods[h]} | {(h, None): (f"growth_{h}", None) for h in periods}
        models = boosting.fit_together(rows, FEATURES, "day", fits, trees=10, depth=3) if fits else {}
        for h in HORIZONS:
            if h not in periods:
                self.reasons[h] = ["insufficient rows"]
                continue
            tests = [learning.predict(models[h, p.fold], known[h].where(F.col("day").between(p.start, p.stop)), "fitted") for p in periods[h] if (h, p.fold) in models]
            if not tests:
                self.reasons[h] = ["insufficient folds"]
                continue
            ape = lambda g: F.abs(F.exp(g - F.col(f"growth_{h}")) - 1)
            m = reduce(DataFrame.unionByName, tests).agg(F.avg(ape(F.col("fitted"))).alias("model"), F.avg(ape(F.lit(0.0))).alias("flat"), F.avg(ape(F.coalesce(f"momentum_{h}", F.lit(0.0)))).alias("trend"), F.count(F.lit(1)).alias("n"))
            row = folds.gate(m, [("too few test rows", F.col("n") >= 30), ("no better than no change", F.col("model") < F.col("flat")), ("no better than the trend", F.col("model") < F.col("trend"))]).first()
            self.reasons[h] = list(row.reasons)
            if row.passed:
                self.models[h] = models[h, None]
        return self

    def forecast(self, requests: DataFrame) -> DataFrame:
        """requests: area, building, kind. Features as of the day after the data end, from rows without a value.
        Deployed forecasts come with the features that contribute most, in words."""
        places = ["area", "building", "kind"]
        end = F.broadcast(self.sales.agg(F.date_add(F.max("date"), 1).alias("__end")))
        asked = requests.select(*places).distinct().join(end).withColumnRenamed("__end", "date").withColumn("asked", F.lit(True))
        # What the day of the requests sees: sales in some frame, and the last day of each place.
        seen = reduce(or_, [F.datediff("date", "__end").between(*frame) for frame in (*FRAMES.values(), YEAR)])
        history = self.sales.select(*places, "date", "size", "price").join(end).where(seen).drop("__end")
        history = history.unionByName(self.sales.groupBy(*places).agg(F.max("date").alias("date")), allowMissingColumns=True)
        rows = keys(history.unionByName(asked, allowMissingColumns=True)).select(*places, "building_key", "area_key", "day", "ppsm", "asked")
        rows = cut(dataset(cut(rows, "history"), "asked").withColumn("log_base", F.ln("base")), "asked")
        for h in HORIZONS:
            if h in self.models:
                scored = contributions.with_contributions(self.models[h], learning.predict(self.models[h], rows, f"forecast_{h}"), FEATURES)
                told = evaluation.drivers(F.col("contributions"), DRIVERS, LEAST_DRIVER)
                rows = scored.withColumns({f"drivers_{h}": driver_lines(told, DRIVER_NAMES), f"state_{h}": F.lit("deployed")}).drop("contributions", "base_value")
            else:
                nothing = F.lit(None).cast("array<string>")
                rows = rows.withColumns({f"forecast_{h}": F.lit(None).cast("double"), f"drivers_{h}": nothing, f"state_{h}": F.lit("not_deployed: " + "; ".join(self.reasons.get(h, [])))})
        return rows.select("area", "building", "kind", "level", "base", *[f"{x}_{h}" for h in HORIZONS for x in ("forecast", "state", "drivers")])
