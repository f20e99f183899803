"""Spark ML stages: class-balanced pair scores, boosted regression with a validation flag, and a pointwise ranker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import cut


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`, so that both classes weigh the same."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).first()
    pos, neg = max(int(n.pos or 0), 1), max(n.n - int(n.pos or 0), 1)
    return df.withColumn("weight", F.when(F.col(label) == 1, n.n / (2.0 * pos)).otherwise(n.n / (2.0 * neg)))


def fit_pair_model(df: DataFrame, features: list[str], label: str, reg: float | None = None) -> PipelineModel:
    """Standardised, class-balanced logistic regression; the penalty is that of C = 1 unless given."""
    rows = balanced_weights(df, label)
    reg = 1.0 / max(1, df.count()) if reg is None else reg
    stages = [Imputer(inputCols=features, outputCols=[f"{c}__i" for c in features]), VectorAssembler(inputCols=[f"{c}__i" for c in features], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", regParam=reg)]
    return Pipeline(stages=stages).fit(rows)


def pair_scores(model: PipelineModel, df: DataFrame, zeroed: str | None = None) -> DataFrame:
    """Adds score; with `zeroed`, that feature counts as 0, as for a price-blind score."""
    rows = df.withColumn(zeroed, F.lit(0.0)) if zeroed else df
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score")


#: Rows of a task that trees are fitted on, about; the learner holds a task's rows in memory and reads them for each level.
TASK_ROWS = 500_000


def spread_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns, in as many partitions as keep a task to about TASK_ROWS, where files would make fewer, larger ones."""
    df = df.select(*columns)
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df


#: Rows from which on trees are fitted on sums of equally binned rows, bins of a feature (those of the learner), and the
#: finer ones whose weights are summed to find them.
BINNED_ROWS, BINS, FINE = 2_000_000, 32, 512


def fit_boosted(df: DataFrame, features: list[str], label: str, weight: str | None = None, validation: str | None = None, trees: int = 30, depth: int = 5, step: float = 0.1, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees; rows with a true validation flag stop the growth early. Many rows are binned first."""
    gbt = GBTRegressor(featuresCol="x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    # Trees split missing values off by themselves, so a number beyond all others stands for them.
    filled = ", ".join(f"coalesce(cast(`{c}` as double), -1e9) as `{c}__i`" for c in features)
    fill, inputs = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"), [f"{c}__i" for c in features]
    df = df.select(*dict.fromkeys(c for c in [*features, label, weight, validation] if c))
    if df.count() >= BINNED_ROWS:
        return _fit_binned(fill.transform(df), fill, inputs, gbt, label, weight, validation)
    return Pipeline(stages=[fill, VectorAssembler(inputCols=inputs, outputCol="x"), gbt]).fit(spread_rows(df, df.columns))


def _fit_binned(df: DataFrame, fill: SQLTransformer, inputs: list[str], gbt: GBTRegressor, label: str, weight: str | None, validation: str | None) -> PipelineModel:
    """The trees of all rows, fitted on far fewer. The learner tells a feature's values apart by BINS bins only, and for
    squared errors needs no more of the rows of one combination of bins than the sums of their weights, labels and squares:
    two rows with half the weight each, one standard deviation to either side of the mean, have the same."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(float("nan"))) if weight else F.lit(1.0)
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))  # the learner refuses these
    bins = [f"{c}__b" for c in inputs]
    binner = Bucketizer(splitsArray=bin_edges(df, inputs, w), inputCols=inputs, outputCols=bins)
    keys = bins + ([validation] if validation else [])
    sums = binner.transform(df).withColumns({b: F.col(b).cast("int") for b in bins}).groupBy(*keys).agg(F.sum(w).alias("__w"), F.sum(w * y).alias("__wy"), F.sum(w * y * y).alias("__wyy")).where("__w > 0")
    mean = F.col("__wy") / F.col("__w")
    off = F.sqrt(F.greatest(F.col("__wyy") / F.col("__w") - mean * mean, F.lit(0.0)))
    rows = cut(sums.select(*keys, (F.col("__w") / 2).alias("__w"), F.explode(F.array(mean - off, mean + off)).alias(label)), "binned")
    assembler = VectorAssembler(inputCols=bins, outputCol="x")
    # maxBins is what the learner samples for its own bins (its square in rows), so that it meets all of these
    model = gbt.copy().setMaxBins(BINS * BINS).setWeightCol("__w").fit(assembler.transform(spread_rows(rows, rows.columns)))
    return PipelineModel([fill, binner, assembler, model])


def bin_edges(df: DataFrame, columns: list[str], w: Column) -> list[list[float]]:
    """Of each column, the edges (both infinities among them) of at most BINS bins of like weight."""
    found = df.approxQuantile(columns, [i / FINE for i in range(1, FINE)], 0.25 / FINE)
    fine = [[-np.inf, *sorted(set(q)), np.inf] for q in found]
    outputs = [f"{c}__f" for c in columns]
    placed = Bucketizer(splitsArray=fine, inputCols=columns, outputCols=outputs).transform(df)
    each = F.explode(F.array(*[(F.col(c) + i * (FINE + 1)).cast("int") for i, c in enumerate(outputs)])).alias("__p")
    weights = dict(placed.select(w.alias("__w"), each).groupBy("__p").agg(F.sum("__w")).collect())  # FINE + 1 of a column at most
    out = []
    for i, edges in enumerate(fine):
        own = np.array([weights.get(i * (FINE + 1) + k, 0.0) for k in range(len(edges) - 1)])
        kept = like_weights(own, BINS)
        out.append([-np.inf, *(edges[k] for k in kept), np.inf] if len(kept) else [-np.inf, edges[1], np.inf])
    return out


def like_weights(own: np.ndarray, bins: int) -> np.ndarray:
    """Of bins with these weights, the first of each but the lowest when they are joined to at most so many of like weight."""
    inner = np.flatnonzero(own[1:]) + 1  # an edge below an empty bin parts nothing
    before = np.cumsum(own)[inner - 1] / own.sum()
    return inner if len(inner) < bins else inner[np.unique(np.searchsorted(before, np.arange(1, bins) / bins).clip(0, len(inner) - 1))]


def split_thresholds(model: PipelineModel) -> Callable[[int, float], float]:
    """From feature and threshold of a split of the model's trees, the number that values beyond exceed."""
    binners = [stage for stage in model.stages if isinstance(stage, Bucketizer)]
    if not binners:
        return lambda feature, threshold: threshold
    edges = binners[0].getSplitsArray()
    return lambda feature, threshold: float(np.nextafter(edges[feature][int(threshold // 1) + 1], -np.inf))


def predict(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out).select(*df.columns, out)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance; stands in for per-row contributions, which Spark ML does not give."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def bootstrap_mean(df: DataFrame, value: str, rounds: int = 200, seed: int = 5, level: float = 0.95) -> DataFrame:
    """(mean, low, high): percentile bounds of the mean under Poisson(1) resampling, one pass, no collected vector.

    Each row gets a weight per round from hashes of its value's row, so results repeat for a given row order of keys.
    """
    weights = F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")
    u = (F.pmod(F.xxhash64("__row", "round", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    poisson, total = F.lit(0), 0.36787944117144233
    term = total
    for k in range(1, 8):
        poisson = poisson + (u > total).cast("int")
        term /= k
        total += term
    rows = df.select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("__row")).select("v", "__row", weights).withColumn("w", poisson)
    means = rows.groupBy("round").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    bounds = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("b"))
    return df.agg(F.avg(value).alias("mean")).join(F.broadcast(bounds)).select("mean", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
