"""Boosted regression trees of several labels and periods over the same rows, fitted together.

Features are binned once and rows packed into blocks of arrays. For each level of the trees one job adds up, in the
tasks that hold the blocks, labels and counts by bin of each feature; all fits share it, and the driver gets these sums
and no rows. Squared errors need no more, so trees are those of all rows however many combinations of bins there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terrane.operators.learning import BINS, like_weights
from terrane.session import cut

#: Bins of a feature that sums are made of, of which a fit has BINS of like weight among its own rows, rows of a block,
#: and what stands for missing values.
GRID, BLOCK_ROWS, MISSING = 255, 1 << 15, -1e9


@dataclass
class Node:
    """Mean and weight of a node's training rows; values of the feature up to the limit go left."""

    value: float
    weight: float
    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class BoostedTrees:
    features: list[str]
    trees: list[Node] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction."""
        x = [filled(c) for c in self.features]

        def at(node: Node) -> Column:
            return F.lit(float(node.value)) if node.left is None else F.when(x[node.feature] <= F.lit(node.limit), at(node.left)).otherwise(at(node.right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + at(tree) * F.lit(weight)
        return df.withColumn("prediction", total)


def filled(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.lit(MISSING))


@dataclass
class Growing:
    """A fit under way: full trees as splits (feature, bin) in the order of a heap and values of all leaves, and the
    splits of the tree that grows."""

    label: int
    before: int | None
    trees: list[tuple[list, np.ndarray]] = field(default_factory=list)
    splits: list = field(default_factory=list)
    nodes: list = field(default_factory=list)
    bins: list | None = None  # of each feature, those after which it may be cut


def fit_together(rows: DataFrame, features: list[str], order: str, fits: dict[str, tuple[str, int | None]], trees: int = 10, depth: int = 3, step: float = 0.1) -> dict[str, BoostedTrees]:
    """A model for each of `fits`, named by its label and the value of `order` that its rows lie before (all rows if
    None). Rows whose label is null take no part; a fit without rows gets no model."""
    labels = list(dict.fromkeys(label for label, _ in fits.values()))
    asked = rows.where(F.coalesce(*[F.col(c) for c in labels]).isNotNull()).select(*[filled(c).alias(f"x{i}") for i, c in enumerate(features)], *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)], F.col(order).cast("long").alias("at"))
    found = asked.approxQuantile([f"x{i}" for i in range(len(features))], [i / GRID for i in range(1, GRID)], 0.25 / GRID)
    edges = [np.array(sorted(set(q))) for q in found]
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # each sends sums of a fixed size
    packed = asked.mapInArrow(packer(edges, len(labels)), "label int, n int, at binary, y binary, x binary")
    blocks = cut(packed.repartition(2 * tasks), "packed").coalesce(tasks).rdd  # blocks dealt evenly

    growing = {name: Growing(labels.index(label), before) for name, (label, before) in fits.items()}
    models = {name: BoostedTrees(features) for name in fits}
    for number in range(trees):
        for fit in growing.values():
            fit.splits, fit.nodes = [None] * (2**depth - 1), [None] * (2 ** (depth + 1) - 1)
        for level in range(depth):
            total = None
            for own in blocks.mapPartitions(adder(growing, level, len(features), step)).collect():
                total = own if total is None else {name: total[name] + own[name] for name in own}
            for name in list(growing):
                if total is None or not total[name][0, 0, :, 1].any():
                    del growing[name], models[name]
                    continue
                grow(growing[name], total[name], level)
        for name, fit in growing.items():
            fit.trees.append((fit.splits, leaf_values(fit.nodes, depth)))
            models[name].trees.append(tree_of(fit.nodes, fit.splits, edges, 0))
            models[name].weights.append(step if number else 1.0)
        if not growing:
            break
    return models


def packer(edges: list[np.ndarray], labels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to blocks: for each label those that have it, by their place in the order, with the bins of each feature."""

    def blocks_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        at = table.column("at").fill_null(np.iinfo(np.int64).max).to_numpy()
        rank = np.argsort(at, kind="stable")
        at = at[rank]
        x = [np.searchsorted(e, table.column(f"x{i}").to_numpy()[rank], "left").astype(np.uint8) for i, e in enumerate(edges)]
        for label in range(labels):
            column = table.column(f"y{label}")
            held, y = ~column.is_null().to_numpy()[rank], column.fill_null(0.0).to_numpy()[rank]
            if np.isnan(y[held]).any():
                raise ValueError("labels must not be NaN")
            if held.any():
                arrays = [[label], [int(held.sum())], [at[held].tobytes()], [y[held].tobytes()], [np.concatenate([b[held] for b in x]).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["label", "n", "at", "y", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                held.append(batch.slice(start, BLOCK_ROWS - n))
                start, n = start + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK_ROWS:
                    yield from blocks_of(held)
                    held, n = [], 0
        if n:
            yield from blocks_of(held)

    return run


def codes(x: list[np.ndarray], splits: list, levels: int, node: int = 0) -> np.ndarray | np.uint8:
    """The number of each row's node so many levels below; a node that is not split counts as left."""
    if levels == 0 or splits[node] is None:
        return np.uint8(0)
    feature, after = splits[node]
    right = (x[feature] > after).view(np.uint8)
    if levels == 1:
        return right
    a, b = codes(x, splits, levels - 1, 2 * node + 1), codes(x, splits, levels - 1, 2 * node + 2)
    return a ^ ((a ^ (b | np.uint8(1 << levels - 1))) & np.negative(right))


def adder(growing: dict[str, Growing], level: int, features: int, step: float) -> Callable[[Iterator[Row]], Iterator[dict[str, np.ndarray]]]:
    """Blocks to one array for each fit: node of the level, feature, bin, (sum, count)."""

    def run(blocks: Iterator[Row]) -> Iterator[dict[str, np.ndarray]]:
        cells = (1 << level) * (GRID + 1)
        out = {name: np.zeros((features, cells, 2)) for name in growing}
        place, residual, part = np.empty(BLOCK_ROWS, np.intp), np.empty(BLOCK_ROWS), np.empty(BLOCK_ROWS)  # used again for each block
        first = np.empty(BLOCK_ROWS, np.intp)
        for block in blocks:
            at, y, every = np.frombuffer(block.at, np.int64), np.frombuffer(block.y), np.frombuffer(block.x, np.uint8).reshape(features, block.n)
            for name, fit in growing.items():
                n = block.n if fit.before is None else int(np.searchsorted(at, fit.before, "left"))
                if fit.label != block.label or n == 0:
                    continue
                x, r = [b[:n] for b in every], y[:n]
                if fit.trees:
                    r = residual[:n]
                    np.copyto(r, y[:n])
                    for number, (splits, values) in enumerate(fit.trees):
                        np.copyto(place[:n], codes(x, splits, len(values).bit_length() - 1))
                        r -= np.take(values * step if number else values, place[:n], out=part[:n], mode="clip")
                    r *= 2.0  # the negative gradient
                np.multiply(codes(x, fit.splits, level), GRID + 1, out=first[:n], dtype=np.intp)
                for i, bins in enumerate(x):
                    cell = np.add(first[:n], bins, out=place[:n])
                    out[name][i, :, 0] += np.bincount(cell, r, cells)
                    out[name][i, :, 1] += np.bincount(cell, minlength=cells)
        yield {name: v.reshape(features, 1 << level, GRID + 1, 2).swapaxes(0, 1) for name, v in out.items()}

    return run


def grow(fit: Growing, sums: np.ndarray, level: int) -> None:
    """Splits the nodes of a level where that lowers the squared error most, first features and bins first."""
    if fit.bins is None:
        fit.bins = [like_weights(of[:, 1], BINS) - 1 for of in sums[0]]
    for k in range(1 << level):
        node = (1 << level) - 1 + k
        s, n = sums[k, 0].sum(axis=0)
        if node and fit.nodes[node] is None or n == 0:
            continue
        fit.nodes[node] = s / n, n
        best = (0.0, None)
        for feature, after in enumerate(fit.bins):
            ls, ln = sums[k, feature].cumsum(axis=0)[after].T
            rs, rn = s - ls, n - ln
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((ln > 0) & (rn > 0), ls * ls / ln + rs * rs / rn - s * s / n, 0.0)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (gain[i], (feature, int(after[i]), (ls[i] / ln[i], ln[i]), (rs[i] / rn[i], rn[i])))
        if best[1]:
            fit.splits[node] = best[1][:2]
            fit.nodes[2 * node + 1], fit.nodes[2 * node + 2] = best[1][2:]


def leaf_values(nodes: list, depth: int) -> np.ndarray:
    """The values of all places of the last level; rows of a node that is not split are at its leftmost."""
    out = np.zeros(1 << depth)
    for place in range(1 << depth):
        node = (1 << depth) - 1 + place
        while nodes[node] is None:
            node = (node - 1) // 2
        out[place] = nodes[node][0]
    return out


def tree_of(nodes: list, splits: list, edges: list[np.ndarray], at: int) -> Node:
    value, weight = nodes[at]
    if at >= len(splits) or splits[at] is None:
        return Node(float(value), float(weight))
    feature, after = splits[at]
    return Node(float(value), float(weight), feature, float(edges[feature][after]), tree_of(nodes, splits, edges, 2 * at + 1), tree_of(nodes, splits, edges, 2 * at + 2))
