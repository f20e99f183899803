"""Listwise learning to rank: boosted trees on the lambda gradients of NDCG, with Newton steps in the leaves.

Each round scores all rows, works out for every query how much swapping two of its rows would change NDCG@k and in
which direction each row is pushed by that, fits a Spark ML regression tree to these pushes, and gives each leaf the
Newton step of its rows. Of a query's pairs only those with a row among the first k count, so a query costs its rows
times k. A query's rows are worked on together, in one task; queries are spread over all tasks. Rounds are cut by
written tables. The driver gets trees and two sums for each leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrane.session import cut

MISSING = -1e9


@dataclass
class Boxes:
    """The leaves of a tree, from left to right, as boxes (low, high] over features."""

    low: np.ndarray  # leaves x features
    high: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for i, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            out[((x > low) & (x <= high)).all(axis=1)] = i
        return out


def boxes_of(root, n_features: int) -> Boxes:
    leaves, waiting = [], [(root, np.full(n_features, -np.inf), np.full(n_features, np.inf))]
    while waiting:
        node, low, high = waiting.pop()
        if node.subtreeDepth() == 0:
            leaves.append((low, high))
            continue
        feature, threshold = node.split().featureIndex(), node.split().threshold()
        below, above = high.copy(), low.copy()
        below[feature], above[feature] = min(high[feature], threshold), max(low[feature], threshold)
        waiting += [(node.rightChild(), above, high), (node.leftChild(), low, below)]
    return Boxes(np.array([low for low, _ in leaves]), np.array([high for _, high in leaves]))


@dataclass
class ListwiseRanker:
    features: list[str]
    trees: list[tuple[Boxes, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for boxes, values in self.trees:
            total += values[boxes.leaf(x)]
        return total


def pushes(score: np.ndarray, grade: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The gradient and the curvature of each row of one query; equal scores rank by the rows' order."""
    n = len(score)
    gradient, curvature = np.zeros(n), np.zeros(n)
    gain = np.exp2(grade) - 1
    discount = np.where(np.arange(n) < k, 1 / np.log2(np.arange(n) + 2), 0)
    best = float((np.sort(gain)[::-1] * discount).sum())
    if best <= 0:
        return gradient, curvature
    order = np.argsort(-score, kind="stable")
    s, g, at = score[order], gain[order], np.arange(n)
    for i in range(min(k, n)):
        j = at[i + 1 :][g[i + 1 :] != g[i]]
        up = np.where(g[i] > g[j], 1.0, -1.0)
        weight = np.abs(g[i] - g[j]) * (discount[i] - discount[j]) / best
        wrong = 1 / (1 + np.exp(np.clip(up * (s[i] - s[j]), -60, 60)))
        push, bend = up * weight * wrong, weight * wrong * (1 - wrong)
        gradient[order[i]] += push.sum()
        curvature[order[i]] += bend.sum()
        gradient[order[j]] -= push
        curvature[order[j]] += bend
    return gradient, curvature


def feature_array(features: list[str]):
    return F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(MISSING)), F.lit(MISSING)) for f in features])


def fit_listwise(df: DataFrame, query: str, item: str, grade: str, features: list[str], k: int = 10, trees: int = 20, depth: int = 4, step: float = 0.2, ridge: float = 0.01, seed: int = 7) -> ListwiseRanker:
    """df has one row for each query and item; grades are whole numbers from 0. Missing features count as MISSING."""
    model = ListwiseRanker(features)
    rows = cut(df.where(F.col(query).isNotNull() & F.col(grade).isNotNull()).select(F.col(query).alias("query"), F.col(item).alias("item"), F.col(grade).cast("double").alias("grade"), feature_array(features).alias("x"), F.lit(0.0).alias("score")), "ranked")
    columns = rows.columns
    schema = rows.select("*", F.lit(0.0).alias("gradient"), F.lit(0.0).alias("curvature")).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending")])
        gradient, curvature = pushes(table.column("score").to_numpy(), table.column("grade").to_numpy(), k)
        return table.append_column("gradient", pa.array(gradient)).append_column("curvature", pa.array(curvature))

    for number in range(trees):
        pushed = cut(rows.groupBy("query").applyInArrow(run, schema).withColumn("vector", array_to_vector("x")), "pushed")
        tree = DecisionTreeRegressor(featuresCol="vector", labelCol="gradient", maxDepth=depth, seed=seed + number, leafCol="leaf", minInstancesPerNode=2).fit(pushed)
        placed = tree.transform(pushed)
        sums = {int(r.leaf): (r.g, r.c) for r in placed.groupBy("leaf").agg(F.sum("gradient").alias("g"), F.sum("curvature").alias("c")).collect()}
        boxes = boxes_of(tree._java_obj.rootNode(), len(features))
        values = np.array([step * sums[i][0] / (sums[i][1] + ridge) if i in sums else 0.0 for i in range(len(boxes.low))])
        if len(values) < 2:
            break  # no split is of use any more
        model.trees.append((boxes, values))
        gained = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("leaf").cast("int") + 1)
        rows = cut(placed.select(*[c for c in columns if c != "score"], (F.col("score") + gained).alias("score")).select(*columns), "ranked")
    return model


def scored_rows(shared, n_features: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(batch.columns) - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(x))], schema=schema)

    return run


def with_scores(model: ListwiseRanker, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the ranker's score; higher ranks first."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.withColumn(name, F.lit(0.0).cast("double")).schema
    for f in schema.fields:
        f.nullable = True
    return df.withColumn("__x", feature_array(model.features)).mapInArrow(scored_rows(shared, len(model.features), to_arrow_schema(schema)), schema)
