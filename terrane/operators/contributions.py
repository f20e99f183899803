"""Per-row contributions of features to the predictions of boosted trees: exact Shapley values of tree paths.

A tree's expectation with only some features known follows the known splits and averages the others by the training
weight of their branches. For a leaf, all that matters of a row is which of the leaf's path features lead there; for
each of these patterns the Shapley values are worked out once, on the driver, and a row looks them up. Trees are
flattened to leaves with intervals of features, so rows are scored by arrays, in the tasks that hold them. A row's
contributions and the base add up to its prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrane.operators import learning
from terrane.operators.boosting import BoostedTrees, Node


@dataclass
class Leaf:
    """Features of the path, the interval (low, high] of each that leads here, and the Shapley values by pattern."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray  # patterns x features; bit j of a pattern: feature j leads here


def shapley_table(value: float, shares: list[float]) -> np.ndarray:
    """Shapley values of the game in which a set of features is worth `value` times, of each feature, whether it leads
    to the leaf if it is in the set, else the share of training weight that its branches let through."""
    d = len(shares)
    out = np.zeros((1 << d, d))
    for pattern in range(1 << d):
        leads = [pattern >> j & 1 for j in range(d)]
        for i in range(d):
            others = [j for j in range(d) if j != i]
            total = 0.0
            for size in range(d):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                for chosen in combinations(others, size):
                    total += weight * np.prod([leads[j] if j in chosen else shares[j] for j in others])
            out[pattern, i] = value * (leads[i] - shares[i]) * total
    return out


def leaves_of(root: Node, scale: float) -> tuple[list[Leaf], float]:
    """The leaves of a tree from its root, and its weighted mean."""
    leaves, base = [], 0.0
    waiting = [(root, {})]
    while waiting:
        at, path = waiting.pop()
        if at.left is None:
            value = scale * at.value
            features = sorted(path)
            shares = [path[f][2] for f in features]
            base += value * float(np.prod(shares))
            if features:
                leaves.append(Leaf(np.array(features), np.array([path[f][0] for f in features]), np.array([path[f][1] for f in features]), shapley_table(value, shares)))
            continue
        low, high, share = path.get(at.feature, (-np.inf, np.inf, 1.0))
        part = at.left.weight / (at.left.weight + at.right.weight)
        waiting.append((at.left, path | {at.feature: (low, min(high, at.limit), share * part)}))
        waiting.append((at.right, path | {at.feature: (max(low, at.limit), high, share * (1 - part))}))
    return leaves, base


def node_of(node, beyond: Callable[[int, float], float]) -> Node:
    """A Spark ML tree from its root; only splits of numbers, at `beyond` of feature and threshold."""
    value, weight = node.prediction(), node.impurityStats().count()
    if node.subtreeDepth() == 0:
        return Node(value, weight)
    split = node.split()
    return Node(value, weight, split.featureIndex(), beyond(split.featureIndex(), split.threshold()), node_of(node.leftChild(), beyond), node_of(node.rightChild(), beyond))


def flattened(model: PipelineModel | BoostedTrees) -> tuple[list[Leaf], float]:
    """All leaves of the ensemble (of a pipeline, the last stage), their values times the tree's weight, and the base."""
    if isinstance(model, BoostedTrees):
        trees, weights = model.trees, model.weights
    else:
        beyond = learning.split_thresholds(model)
        trees, weights = [node_of(tree._java_obj.rootNode(), beyond) for tree in model.stages[-1].trees], model.stages[-1].treeWeights
    leaves, base = [], 0.0
    for tree, weight in zip(trees, weights, strict=True):
        own, mean = leaves_of(tree, float(weight))
        leaves += own
        base += mean
    return leaves, base


def shapley_values(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows x features."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        own = x[:, leaf.features]
        pattern = ((own > leaf.low) & (own <= leaf.high)) @ (1 << np.arange(len(leaf.features)))
        out[:, leaf.features] += leaf.values[pattern]
    return out


def contribution_rows(shared, n_features: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared.value
        for batch in batches:
            x = batch.column(len(batch.columns) - 1)
            values = shapley_values(leaves, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(values), pa.list_(pa.float64()))], schema=schema)

    return run


def with_contributions(model: PipelineModel | BoostedTrees, df: DataFrame, features: list[str], missing: float = -1e9) -> DataFrame:
    """Adds base, and contributions as (name, value) in the order of the features. Missing values count as `missing`, as
    learning.fit_boosted has them."""
    leaves, base = flattened(model)
    shared = df.sparkSession.sparkContext.broadcast(leaves)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(missing)) for f in features])
    schema = df.withColumn("__c", F.lit(None).cast("array<double>")).schema
    out = df.withColumn("__x", x).mapInArrow(contribution_rows(shared, len(features), to_arrow_schema(schema)), schema)
    named = F.zip_with(F.array(*[F.lit(f) for f in features]), F.col("__c"), lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return out.select(*df.columns, F.lit(base).alias("base_value"), named.alias("contributions"))
