"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits the vectors recursively at the median of a random projection, and vectors within a margin of a split
go to both sides (spill). The first levels are fitted on a bounded sample; leaves that are still large are split again,
each at medians of a sample of its own members, so depth follows the number of vectors. A leaf that spill would copy
whole, a cluster closer than the margin, stays as it is. Every vector is indexed. All vectors of a leaf are compared,
in single precision first and in double precision where that comes near the threshold, and links at or above it are
counted, united and turned into components. Equal vectors are one class from the start, so copies are never compared.

A pair that shares leaves of several trees counts in the first of them only, so counts need no list of pairs; a leaf
returns counts and a spanning forest, one row per vector at most. Leaves beyond BLOCK vectors are dealt out as pairs
of blocks. Vectors of different lengths never link: each length with more than LEAF vectors, one leaf's aim, has its own
forest, any other is one leaf.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Repeated
rows link with each other. A null id never names a component unless no member has one. An empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import attached, bounded_batches, mix
from terrane.operators.graph import connected_components
from terrane.session import cut

COSINE, TREES = 0.95, 5
#: Vectors that the first levels of a length are fitted on, vectors of one leaf that its further levels are fitted on,
#: the size of a leaf that is aimed at, the size beyond which one is split again, and the rows of a block.
SAMPLE, LEAF_SAMPLE, LEAF, LIMIT, BLOCK = 20_000, 1024, 256, 4096, 2048
#: Half the width of the spill, in standard deviations of the projected distance of two vectors at the threshold.
SPILL = 0.75
#: Share of its leaf that a child may hold for a further split to be of use, and the most rounds of splitting.
USEFUL, ROUNDS = 0.75, 8


@dataclass
class Tree:
    """Splits in heap order; directions follow from the seed, so they need not travel."""

    seed: int
    splits: np.ndarray
    depth: int

    def directions(self, dims: int) -> np.ndarray:
        found = np.random.default_rng(self.seed).normal(size=(max(1, (1 << self.depth) - 1), dims))
        return found / np.linalg.norm(found, axis=1, keepdims=True)

    def leaves(self, unit: np.ndarray, directions: np.ndarray, margin: float, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row belongs to, leaves numbered from 0."""
        depth = self.depth if depth is None else depth
        row, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for _ in range(depth):
            gap = np.einsum("ij,ij->i", unit[row], directions[node]) - self.splits[node]
            left, right = gap <= margin, gap >= -margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (1 << depth) + 1


def margin_of(cosine: float, dims: int) -> float:
    return float(SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(dims))


def grow(sample: np.ndarray, count: int, seed: int) -> Tree:
    """A tree for `count` vectors, fitted on unit vectors of a sample, at least 16 for each of its leaves."""
    depth = max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))
    tree = Tree(seed, np.zeros(0), min(depth, max(0, int(np.log2(max(1, len(sample) / 16))))))
    inner = (1 << tree.depth) - 1
    directions, members = tree.directions(sample.shape[1]), {0: sample}
    tree.splits = np.zeros(max(inner, 1))
    for node in range(inner):
        own = members.pop(node)
        at = own @ directions[node]
        tree.splits[node] = split = np.median(at) if len(at) else 0.0
        members[2 * node + 1], members[2 * node + 2] = own[at <= split], own[at > split]
    return tree


def sub_leaf(leaf: np.ndarray, child: np.ndarray) -> np.ndarray:
    """A name for a leaf's child, positive and, but for chance, its own."""
    name = mix(leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + child.astype(np.uint64) + np.uint64(1))
    return (name >> np.uint64(1)).astype(np.int64) | np.int64(1 << 62)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def leaf_rows(forests: dict[int, list[Tree]], cosine: float):
    """All leaves of each vector; those of all forests are numbered through, lengths without one are leaf -length."""
    first, starts = 0, {}
    for dims, forest in forests.items():
        for number, tree in enumerate(forest):
            starts[dims, number] = first
            first += 1 << tree.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dims")).to_numpy()
            rows, leaves = [np.flatnonzero(~np.isin(dims, list(forests)))], []
            leaves.append(-dims[rows[0]].astype(np.int64))
            for length, forest in forests.items():
                own = np.flatnonzero(dims == length)
                if not len(own):
                    continue
                if length not in ready:
                    ready[length] = [tree.directions(length) for tree in forest]
                unit = unit_rows(matrix(batch.column(batch.schema.get_field_index("v")).take(pa.array(own))))
                for number, tree in enumerate(forest):
                    row, leaf = tree.leaves(unit, ready[length][number], margin_of(cosine, length))
                    rows.append(own[row])
                    leaves.append(leaf + starts[length, number])
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            order = np.lexsort((leaf, row))
            offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), lists], names=["node", "leaves"])

    return run


def fitted_rows(cosine: float):
    """The further levels of a large leaf, from a sample of its members: as deep as they still part them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit, leaf = unit_rows(matrix(table.column("v"))), key[0].as_py()
        tree = grow(unit, table.column("size")[0].as_py(), leaf & 0x7FFFFFFF)
        directions, margin, depth = tree.directions(unit.shape[1]), margin_of(cosine, unit.shape[1]), tree.depth
        while depth and np.bincount(tree.leaves(unit, directions, margin, depth)[1]).max() > USEFUL ** max(1, depth / 2) * len(unit):
            depth -= 1
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "depth": pa.array([depth], pa.int32()), "splits": pa.array([tree.splits[: max(1, (1 << depth) - 1)].tobytes()], pa.binary())})

    return run


def split_rows(cosine: float):
    """The leaves of each post of a leaf that is split after one more round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            node, leaf, depth = column("node").to_numpy(), column("leaf").to_numpy(), column("depth").to_numpy()
            nodes, leaves = [node[:0]], [leaf[:0]]
            for name in np.unique(leaf).tolist():
                own = np.flatnonzero(leaf == name)
                unit = unit_rows(matrix(column("v").take(pa.array(own))))
                tree = Tree(name & 0x7FFFFFFF, np.frombuffer(column("splits")[int(own[0])].as_py(), dtype=np.float64), int(depth[own[0]]))
                row, child = tree.leaves(unit, tree.directions(unit.shape[1]), margin_of(cosine, unit.shape[1]))
                nodes.append(node[own][row])
                leaves.append(sub_leaf(np.full(len(child), name), child))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(leaves), pa.int64())], names=["node", "leaf"])

    return run


def linked_rows(cosine: float):
    """Of a leaf, or two blocks of one: counts of linked vectors (b null), and a spanning forest of the links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        side = table.column("side").to_numpy()
        vectors = matrix(table.column("v"))
        unit = unit_rows(vectors).astype(np.float32)
        near = unit @ unit.T >= cosine - 1e-5
        np.fill_diagonal(near, False)
        if side[0] >= 0:
            near &= side[:, None] != side[None, :]
        held = np.flatnonzero(near.any(axis=1))  # all others link with nothing here
        table, vectors, near = table.take(pa.array(held)), vectors[held], near[np.ix_(held, held)]
        node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
        norm = np.linalg.norm(vectors, axis=1)
        near &= (vectors @ vectors.T) / norm[:, None] / norm[None, :] >= cosine
        lists = table.column("leaves").combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        earlier = flat < leaf
        if earlier.any() and near.any():
            names, place = np.unique(flat[earlier], return_inverse=True)
            member = np.zeros((len(node), len(names)), dtype=np.float32)
            member[owner[earlier], place] = 1
            near &= member @ member.T == 0
        counts = near @ size.astype(np.float64)
        seen, left, right = np.zeros(len(node), dtype=bool), [], []
        for i in np.flatnonzero(counts).tolist():
            if seen[i]:
                continue
            seen[i], front = True, np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & ~seen)
                seen[front] = True
                left.append(np.full(len(front), node[i]))
                right.append(node[front])
        own = np.flatnonzero(counts)
        a = np.concatenate([node[own], *left])
        b = pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(np.concatenate(right) if right else [], pa.int64())])
        n = np.concatenate([counts[own].astype(np.int64), np.zeros(len(a) - len(own), dtype=np.int64)])
        return pa.table([pa.array(a, pa.int64()), b, pa.array(n, pa.int64())], schema=schema)

    return run


def indexed(classes: DataFrame, cosine: float, trees: int) -> DataFrame:
    """(node, leaves) of all classes, leaves beyond LIMIT split again as long as that parts their members."""
    lengths = {r.dims: r["count"] for r in classes.groupBy("dims").count().where(F.col("count") > LEAF).collect()}
    forests = {}
    for dims, count in sorted(lengths.items()):
        share = F.pmod(F.xxhash64("node"), F.lit(max(1, count // SAMPLE))) == 0
        sample = matrix(classes.where((F.col("dims") == dims) & share).select("v").limit(2 * SAMPLE).toArrow().column("v"))
        forests[dims] = [grow(unit_rows(sample), count, 11 + tree) for tree in range(trees)]
    placed = cut(classes.select("node", "v", "dims").mapInArrow(leaf_rows(forests, cosine), "node long, leaves array<long>"), "leaves")
    for _ in range(ROUNDS):
        posts = placed.select("node", F.explode("leaves").alias("leaf"))
        large = cut(posts.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LIMIT), "large")
        if large.isEmpty():
            break
        chosen = F.pmod(F.xxhash64("leaf", "node"), F.ceil(F.col("size") / LEAF_SAMPLE)) == 0
        sample = posts.join(large, "leaf").where(chosen).join(classes.select("node", "v"), "node")
        further = cut(sample.select("leaf", "size", "v").groupBy("leaf").applyInArrow(fitted_rows(cosine), "leaf long, depth int, splits binary").where("depth > 0"), "further")
        if further.isEmpty():
            break
        stay = posts.join(further.select("leaf"), "leaf", "left_anti").select("node", "leaf")
        split = posts.join(further, "leaf").join(classes.select("node", "v"), "node").select("node", "leaf", "v", "depth", "splits")
        split = stay.unionByName(split.mapInArrow(split_rows(cosine), "node long, leaf long"))
        placed = cut(split.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")), "leaves")
    return placed


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable by links) and kept."""
    bounded_batches(vectors.sparkSession)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("dims", F.when(F.coalesce(finite, F.lit(False)), F.size("v")))
    rows = rows.withColumn("node", F.when(F.col("dims").isNotNull(), F.xxhash64("v"))).withColumn("other", F.xxhash64("v", F.lit(1)))
    classes = cut(rows.where("node is not null").groupBy("node", "other", "dims").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("size"), F.min("id").alias("low")), "classes")
    placed = indexed(classes, cosine, trees)
    blocks = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > BLOCK).select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    posts = classes.join(placed, "node").select("node", "v", "size", "leaves", F.explode("leaves").alias("leaf")).join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    posts = posts.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("own") != F.col("with"), F.col("own")).otherwise(-1)
    posts = posts.select("leaf", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "v", "size", "leaves", side.alias("side"))
    found = cut(posts.groupBy("leaf", "i", "j").applyInArrow(linked_rows(cosine), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("b is not null"), "a", "b")
    ends = cut(classes.select("node", "low").join(labels, "node"), "ends")
    lows = ends.groupBy("root").agg(F.min("low").alias("component"))
    named = classes.select("node", "size", "low").join(ends.join(lows, "root").select("node", "component"), "node", "left").join(counts, "node", "left")
    named = cut(named.select("node", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id")), "named")
    out = attached(rows.where("node is not null").select("id", "node"), named, ["node"], "size").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
