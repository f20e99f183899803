"""Price estimates: month index, shrunken location priors, boosted residual, conformal ranges, plausibility clip."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import estimates, learning, timeseries
from terrane.session import cut

LEVELS = ["kind", "area", "project", "building"]
#: The columns of each level. A building is told apart within its project, and buildings without one share a scope.
KEYS = {"kind": ["kind"], "area": ["kind", "area"], "project": ["kind", "area", "project"], "building": ["kind", "area", "scope", "building"]}
NO_PROJECT = "\0no project"


def scoped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scope", F.coalesce("project", F.lit(NO_PROJECT)))


@dataclass
class PricePredictor:
    """fit(sales) and predict(requests). Columns: kind, area, project, building, segment, pool, day (date), size, price."""

    shrink: float = 20.0
    half_life: float = 365.0
    min_segment: int = 50
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: object = None

    def _features(self, rows: DataFrame) -> DataFrame:
        """Index, priors and plain columns of requests; unseen places fall back to their parents."""
        index = self.tables["index"].select("segment", F.col("month").alias("m"), F.col("value").alias("index"))
        rows = rows.withColumn("m", timeseries.month_number("day")).join(index, ["segment", "m"], "left")
        rows = rows.join(self.tables["last"], "segment", "left").withColumn("index", F.coalesce("index", "last_index")).drop("last_index")
        return self._priors(rows).withColumn("log_size", F.ln("size"))

    def _priors(self, rows: DataFrame) -> DataFrame:
        """Adds prior_<level> and n_<level> of the rows' places."""
        parent = None
        rows = scoped(rows)
        for level in LEVELS:
            rows = rows.join(self.tables[level], KEYS[level], "left")
            wy, w = F.coalesce("wy", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
            prior = F.when(w > 0, wy / w).otherwise(0.0) if parent is None else (wy + self.shrink * F.col(parent)) / (w + self.shrink)
            parent = f"prior_{level}"
            rows = rows.withColumns({parent: prior, f"n_{level}": F.log1p(w)}).drop("wy", "w")
        return rows.drop("scope")

    FEATURES = ("prior_area", "prior_project", "prior_building", "n_area", "n_project", "n_building", "log_size")

    def fit(self, sales: DataFrame) -> PricePredictor:
        rows = sales.withColumns({"v": F.ln(F.col("price") / F.col("size")), "m": timeseries.month_number("day")})
        span = rows.agg(F.min("m").alias("a"), F.max("m").alias("b"), F.max("day").alias("last")).first()
        index = cut(timeseries.month_index(rows, "segment", "pool", "m", "v", span.a, span.b + 1, 30).where("value is not null"), "index")
        self.tables["index"] = index
        self.tables["last"] = index.groupBy("segment").agg(F.max_by("value", "month").alias("last_index"))
        known = rows.join(index.select("segment", F.col("month").alias("m"), F.col("value").alias("index")), ["segment", "m"])
        check = F.pmod(F.xxhash64("building", "day", "price"), F.lit(5)) == 0
        weight = estimates.recency_weight(F.datediff(F.lit(span.last), "day"), self.half_life, F.lit(1))
        place = F.struct(*LEVELS).alias("place")  # nulls are equal within it
        known = cut(known.select(place, "segment", "v", (F.col("v") - F.col("index")).alias("y"), weight.alias("weight"), F.ln("size").alias("log_size"), check.alias("check")), "relative")
        sums = cut(known.groupBy("place").agg(F.sum(F.col("y") * F.col("weight")).alias("wy"), F.sum("weight").alias("w")), "places")
        for level in LEVELS:
            self.tables[level] = cut(scoped(sums.select("place.*", "wy", "w")).groupBy(*KEYS[level]).agg(F.sum("wy").alias("wy"), F.sum("w").alias("w")), f"prior-{level}")
        # Priors depend on the place alone, so the rows are joined once.
        priors = cut(self._priors(sums.select("place", "place.*")).select("place", *[c for c in self.FEATURES if c != "log_size"]), "priors")
        rows = known.join(priors, "place").select("segment", *self.FEATURES, (F.col("y") - F.col("prior_building")).alias("residual"), "weight", "check")
        rows = cut(rows, "features")
        self.model = learning.fit_boosted(rows, list(self.FEATURES), "residual", "weight", "check")
        scored = learning.predict(self.model, rows.where("check"), "r")
        scored = cut(scored.select("segment", F.abs(F.col("residual") - F.col("r")).alias("error")), "scored")
        self.tables["ranges"] = cut(estimates.conformal_quantiles(scored, "segment", "error", {"q80": 0.2, "q95": 0.05}, self.min_segment), "ranges")
        self.tables["bounds"] = cut(estimates.quantile_bounds(known, ["segment"], "v", 0.01, 0.99).select("segment", "low", "high"), "bounds")
        return self

    def predict(self, requests: DataFrame) -> DataFrame:
        """The requests with estimate, low_80, high_80, low_95, high_95, level and confidence; unknown segments are null."""
        rows = learning.predict(self.model, self._features(requests), "r")
        rows = rows.join(self.tables["ranges"].drop("n"), "segment", "left").join(self.tables["bounds"], "segment", "left")
        log = F.least(F.greatest(F.col("index") + F.col("prior_building") + F.col("r"), F.col("low") - F.ln(F.lit(3.0))), F.col("high") + F.ln(F.lit(3.0)))
        price = lambda x: F.exp(x) * F.col("size")
        level = F.when(F.col("n_building") > F.log1p(F.lit(5)), "building").when(F.col("n_project") > F.log1p(F.lit(5)), "project").when(F.col("n_area") > F.log1p(F.lit(5)), "area").otherwise("city")
        confidence = F.when(F.col("q80") <= 0.15, "high").when(F.col("q80") <= 0.3, "medium").otherwise("low")
        ends = {f"{side}_{q[1:]}": price(log + sign * F.col(q)) for q in ("q80", "q95") for side, sign in (("low", -1), ("high", 1))}
        return rows.select(*requests.columns, price(log).alias("estimate"), *[c.alias(n) for n, c in ends.items()], level.alias("level"), confidence.alias("confidence"))

    def predict_one(self, request: dict) -> dict | None:
        """One request; exactly one place and a positive size are asked for."""
        if not request.get("size") or request["size"] <= 0 or not request.get("segment"):
            raise ValueError("a request needs a segment and a positive size")
        spark = self.tables["bounds"].sparkSession
        columns = {"kind": "string", "area": "string", "project": "string", "building": "string", "segment": "string", "pool": "string", "day": "date", "size": "double"}
        row = spark.createDataFrame([tuple(request.get(c) for c in columns)], ", ".join(f"{c} {t}" for c, t in columns.items()))
        found = self.predict(row).first()
        return found.asDict() if found else None

    def save(self, path: str) -> None:
        """Tables and model below a folder; a model that is there is replaced."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        self.model.write().overwrite().save(f"{path}/model")
        spark = self.tables["bounds"].sparkSession
        settings = spark.createDataFrame([(self.shrink, self.half_life, self.min_segment)], "shrink double, half_life double, min_segment int")
        settings.write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PricePredictor:
        settings = spark.read.parquet(f"{path}/settings").first()
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in ("index", "last", "ranges", "bounds", *LEVELS)}
        return cls(settings.shrink, settings.half_life, settings.min_segment, tables, PipelineModel.load(f"{path}/model"))
