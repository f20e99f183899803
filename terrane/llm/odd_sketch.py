"""MinHash near-dedup with odd sketches.

A document's set holds its distinct five-word shingles, as 64-bit hashes. MinHash samples are banded for candidate
search and folded into a parity bitmap (an odd sketch): each sample flips one bit, so the population count of the XOR
of two bitmaps tells how many samples differ, precisely where similarities are high. Within a bucket of a band the
bitmaps choose the pairs; the full sets confirm each link before components are formed.

Documents with equal sets are one class from the start, so copies never meet as pairs. Of a bucket, only the pairs of
a maximum spanning forest by estimate are confirmed at first, one for each member at most. In a second round the buckets
that still hold different components get the full sets of their members; their task confirms what is left between
different components on these and returns only links that unite some, fewer than there are members, so that no link
between two components is lost and no list of pairs is written. Buckets beyond BLOCK members, or SET_BLOCK shingles in
the second round, are dealt out as pairs of blocks.

Defined results: null texts and texts without words have an empty set, no link and their own id as component. Texts
of fewer than five words have their whole word sequence as the only shingle. Repeated rows share a class; rows that
share an id as well are all marked kept when that id is the component's smallest. A null id never becomes a component's
id unless no member has one. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import LOWERED, attached, bounded_batches, mix, row_key, schemas, text_chunks, window_hashes, word_hashes
from terrane.operators.graph import connected_components
from terrane.session import cut

SHINGLE, PERCENT = 5, 85
#: MinHash samples; the first BANDS * ROWS of them are banded, all are folded into a bitmap of BITS bits.
SAMPLES, BANDS, ROWS, BITS = 480, 24, 5, 2048
#: How far below the threshold a bitmap's estimate may lie and the pair still be confirmed on full sets; lower
#: thresholds widen it as the samples' deviation grows.
SLACK = 0.065
#: Members of a bucket that one task compares, and the size up to which all pairs of a bucket are compared at once.
BLOCK, SMALL = 8192, 5
#: Shingles of the members that one task of the second round holds on either side.
SET_BLOCK = 1_000_000


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    docs = [t.translate(LOWERED).split() for t in texts]
    long = [d if len(d) >= SHINGLE else [] for d in docs]
    h = window_hashes(word_hashes(long), SHINGLE)
    out, at = [], 0
    for d, l in zip(docs, long, strict=True):
        if l:
            out.append(np.unique(h[at : at + len(l) - SHINGLE + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(d), seed=len(d))] if d else [], dtype=np.uint64))
        at += len(l)
    return out


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima for each of the sets, none of which is empty."""
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((SAMPLES, len(sets)), dtype=np.uint32)
    turned = np.empty_like(values)
    for i in range(SAMPLES):
        np.multiply(values, odd[i], out=turned)
        np.add(turned, add[i], out=turned)
        np.minimum.reduceat(turned, starts, out=out[i])
    return np.ascontiguousarray(out.T)


def bitmaps(found: np.ndarray) -> np.ndarray:
    """The odd sketches of rows of samples, as 64-bit words."""
    bit = mix(found.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    out = np.zeros((len(found), BITS), dtype=np.uint8)
    np.add.at(out, (np.arange(len(found))[:, None], bit.astype(np.int64)), 1)
    return np.packbits(out & 1, axis=1).view(np.uint64)


def most_flips(threshold: float) -> int:
    """The largest population count of an XOR whose estimate of the similarity reaches the threshold."""
    flips = np.arange(BITS // 2)
    estimate = 1 - np.log1p(-2 * flips / BITS) / np.log1p(-2 / BITS) / 2 / SAMPLES
    return int(np.flatnonzero(estimate >= threshold)[-1])


def slack(percent: int) -> float:
    return SLACK * max(1.0, (percent * (100 - percent) / (PERCENT * (100 - PERCENT))) ** 0.5)


def flips(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def spanning_forest(maps: np.ndarray, side: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Prim's forest of the members of a bucket, nearest first; members of one block of two are not compared."""
    far = np.int32(BITS + 1)
    n, left, right = len(maps), [], []
    two, best, link, out = side[0] >= 0, np.full(len(maps), far), np.zeros(len(maps), dtype=np.int64), np.zeros(len(maps), dtype=bool)
    now = 0
    for _ in range(n - 1):
        out[now] = True
        found = flips(maps, maps[now])
        if two:
            found[side == side[now]] = far
        nearer = found < best
        best[nearer], link[nearer] = found[nearer], now
        now = int(np.argmin(np.where(out, far + 1, best)))
        if best[now] <= most:
            left.append(int(link[now]))
            right.append(now)
    return left, right


def signature_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch, bands = [None] * len(sets), [None] * len(sets)
            c1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            c2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            if full:
                got = samples([sets[i] for i in full])
                maps = bitmaps(got)
                keys = np.arange(BANDS, dtype=np.uint64)[None, :]
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + got[:, r * BANDS : (r + 1) * BANDS])
                keys = keys.view(np.int64)
                for i, m, b in zip(full, maps, keys, strict=True):
                    sketch[i], bands[i] = m.tobytes(), b
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            arrays = [column("id"), column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1), pa.array(c2), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        sets = pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("k")), sets], names=["node", "hashes"])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Runs of whole buckets, and where each of the run's buckets begins and ends."""
    carry: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Table]:
        t = pa.Table.from_batches(parts)
        part = [t.column(c).to_numpy() for c in ("band", "i", "j")]
        new = np.append(True, np.logical_or.reduce([p[1:] != p[:-1] for p in part]))
        return np.append(np.flatnonzero(new), len(t)), t

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("band", "i", "j")]
        head = carry[0] if carry else None
        if head is not None and any(head.column(head.schema.get_field_index(c))[0].as_py() != k[0] for c, k in zip(("band", "i", "j"), keys, strict=True)):
            yield whole(carry)
            carry = []
        differs = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        last = int(differs[-1]) + 1 if len(differs) else 0  # the run that the batch ends with may go on
        if last:
            yield whole([*carry, batch.slice(0, last)])
            carry = [batch.slice(last)]
        else:
            carry.append(batch)
    if carry:
        yield whole(carry)


def maps_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(t), -1)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pair_rows(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], schema=PAIRS)


def candidate_rows(threshold: float):
    """Pairs of buckets to confirm: all of small buckets, a spanning forest of the others."""
    most = most_flips(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, t in groups(batches):
            node, maps, side = t.column("node").to_numpy(), maps_of(t), t.column("side").to_numpy()
            sizes = np.diff(edges)
            left, right = [], []
            for size in range(2, SMALL + 1):  # all pairs of all small buckets of a size at once
                starts = edges[:-1][sizes == size]
                x, y = np.triu_indices(size, 1)
                x, y = (starts[:, None] + x).ravel(), (starts[:, None] + y).ravel()
                near = flips(maps[x], maps[y]) <= most
                left.append(x[near])
                right.append(y[near])
            for start, end in zip(edges[:-1][sizes > SMALL].tolist(), edges[1:][sizes > SMALL].tolist(), strict=True):
                x, y = spanning_forest(maps[start:end], side[start:end], most)
                left.append(start + np.array(x, dtype=np.int64))
                right.append(start + np.array(y, dtype=np.int64))
            x, y = np.concatenate(left), np.concatenate(right)
            yield pair_rows(node[x], node[y])

    return run


class Overlaps:
    """Sizes of the intersections of one set with others: shingles that many sets hold are bits, the others postings."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.sizes = np.array(list(map(len, sets)))
        owner = np.repeat(np.arange(n), self.sizes)
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = held > max(1, n // 64)
        number = np.cumsum(common) - 1
        self.bits = np.zeros((n, -(-max(1, int(common.sum())) // 64)), dtype=np.uint64)
        use = common[column]
        at = number[column[use]]
        np.bitwise_or.at(self.bits, (owner[use], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        rare = np.flatnonzero(~use & (held[column] > 1))
        order = np.argsort(column[rare], kind="stable")
        self.posted = owner[rare][order]
        ends = np.cumsum(np.bincount(column[rare], minlength=len(held)))
        self.spans = [list(zip((ends[c] - held[c]).tolist(), ends[c].tolist(), strict=True)) for c in np.split(column[rare], np.cumsum(np.bincount(owner[rare], minlength=n))[:-1])]

    def with_others(self, i: int, others: np.ndarray) -> np.ndarray:
        same = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        if self.spans[i]:
            same += np.bincount(np.concatenate([self.posted[a:b] for a, b in self.spans[i]]), minlength=len(self.sizes))[others]
        return same


def uniting_links(maps: np.ndarray, side: np.ndarray, root: np.ndarray, first: np.ndarray, sets: list[np.ndarray], percent: int, most: int) -> tuple[list[int], list[int]]:
    """Links between members of different roots, confirmed on full sets, as few as unite what they unite; pairs that
    have an earlier bucket in common (first: bands of each, and this one's place among them) are left to that."""
    overlaps, left, right = Overlaps(sets), [], []
    part = np.unique(root, return_inverse=True)[1]
    sizes, bands, band = overlaps.sizes, first[:, 1:], first[:, 0]
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        keep = part[later] != part[i]
        if side[0] >= 0:
            keep &= side[later] != side[i]
        keep &= 100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i])
        later = later[keep]
        later = later[flips(maps[later], maps[i]) <= most]
        later = later[bands[i, np.argmax(bands[later] == bands[i], axis=1)] == band[i]] if len(later) else later
        if not len(later):
            continue
        same = overlaps.with_others(i, later)
        for j in later[100 * same >= percent * (sizes[later] + sizes[i] - same)].tolist():
            if part[i] != part[j]:
                left.append(i)
                right.append(j)
                part[part == part[j]] = part[i]
    return left, right


def link_rows(percent: int):
    """Confirmed links of buckets that still hold different roots."""
    most = most_flips(percent / 100 - slack(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, t in groups(batches):
            node, maps, side, root = t.column("node").to_numpy(), maps_of(t), t.column("side").to_numpy(), t.column("root").to_numpy()
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            first = np.column_stack([t.column("band").to_numpy(), bands])
            sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("hashes").to_pylist()]
            left, right = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x, y = uniting_links(maps[a:b], side[a:b], root[a:b], first[a:b], sets[a:b], percent, most)
                left += [a + i for i in x]
                right += [a + j for j in y]
            yield pair_rows(node[left], node[right])

    return run


def confirmed_rows(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "b"))
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("left", "right"))
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(x) // 8 + len(y) // 8
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                same = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * same >= percent * (both - same))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=schema)

    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, k (the row's key), n (size of its set), root (its component, null without words) and
    component_id (smallest id reachable)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("k"))
    spark_schema, arrow = schemas({"id": keyed.schema["id"].dataType, "k": "long", "n": "long", "c1": "long", "c2": "long", "sketch": "binary", "bands": "array<long>"})
    signed = cut(keyed.mapInArrow(signature_rows(arrow), spark_schema), "signatures")
    # Bitmap and bands follow from the set, so any member's will do.
    classes = cut(signed.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("low"), F.min("k").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("held")), "classes")
    posts = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = posts.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    posts = cut(posts.join(shared, "band").join(classes.select("node", "sketch"), "node"), "buckets")

    def dealt(members: DataFrame, blocks: Column) -> DataFrame:
        """Buckets beyond one block are dealt out to every pair of their blocks."""
        members = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when((F.col("blocks") > 1) & (F.col("own") != F.col("other")), F.col("own")).otherwise(F.lit(-1))
        members = members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": side}).drop("blocks", "own", "other")
        return members.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def sets_of(nodes: DataFrame) -> DataFrame:
        made = keyed.select("k", "text").join(nodes.select(F.col("node").alias("k")).distinct().hint("merge"), "k", "left_semi").mapInArrow(set_rows, "node long, hashes binary")
        return cut(made.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")

    first = dealt(posts.select("band", "node", "sketch", "members"), F.ceil(F.col("members") / BLOCK).cast("int"))
    pairs = cut(first.drop("members").mapInArrow(candidate_rows(percent / 100 - slack(percent)), "a long, b long").distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    links = cut(both.select("a", "b", "left", "right").mapInArrow(confirmed_rows(percent), "a long, b long"), "links")
    labels = cut(connected_components(links, "a", "b"), "labels")

    rooted = posts.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Buckets up to SMALL have been compared in full; larger ones of one component have nothing left to add.
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where((F.col("lo") != F.col("hi")) & (F.col("size") > SMALL))
    mixed = cut(rooted.join(mixed.select("band", "shingles"), "band").join(classes.select("node", "bands"), "node"), "mixed")
    if not mixed.isEmpty():
        members = mixed.select("band", "node", "sketch", "bands", "root", "shingles").join(sets_of(mixed), "node")
        more = cut(dealt(members, F.ceil(F.col("shingles") / SET_BLOCK).cast("int")).drop("shingles").mapInArrow(link_rows(percent), "a long, b long"), "links")
        if not more.isEmpty():
            labels = cut(connected_components(links.union(more), "a", "b"), "labels")
    ends = classes.select("node", "low").join(labels, "node")
    lows = ends.groupBy("root").agg(F.min("low").alias("component"))
    ends = ends.join(lows, "root").select("node", "root", "component")
    named = classes.select("c1", "c2", "n", "node", "low", "held").join(ends, "node", "left")
    named = cut(named.select("c1", "c2", "n", "held", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component")).alias("component_id")), "named")
    out = attached(signed.where("n > 0").select("id", "k", "n", "c1", "c2"), named, ["c1", "c2", "n"], "held").drop("c1", "c2")
    return out.unionByName(signed.where("n = 0").select("id", "k", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (smallest id reachable by links) and kept."""
    found = classify(docs, id_col, text_col, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, one of each component: the one with its smallest id. Texts without
    words belong to no component and stay."""
    found = cut(classify(docs, id_col, text_col, percent), "found")
    first = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("k").alias("k")))["k"].alias("k"))
    rows = docs.select(F.struct("*").alias("whole"), row_key(id_col, text_col).alias("k"))
    out = rows.join(first.select("k").union(found.where("n = 0").select("k").distinct()), "k", "left_semi")
    repeated = found.where("n > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    if not repeated.isEmpty():  # equal rows: all but one go
        out = out.join(repeated, "k", "left_anti").unionByName(out.join(repeated, "k", "left_semi").dropDuplicates(["k"]))
    return out.select(*[F.col("whole")[c].alias(c) for c in docs.columns])
