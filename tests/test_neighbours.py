"""Approximate neighbours of all vectors against brute force."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from terrane.operators import neighbours


def brute(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sims, -2)
    return {i: {ids[j] for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k]} for i, row in zip(ids, sims, strict=True)}


def recall(got, expected):
    return sum(len(got.get(i, set()) & own) for i, own in expected.items()) / sum(map(len, expected.values()))


def as_sets(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query, set()).add(r.item)
    return out


def test_recall_on_the_embeddings(spark):
    rows = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null")
    held = rows.collect()
    found = neighbours.neighbours(rows, "vec_id", "embedding", 10).collect()
    expected = brute([r.vec_id for r in held], np.array([r.embedding for r in held], dtype=np.float64), 10)
    assert recall(as_sets(found), expected) >= 0.9
    assert len(held) // neighbours.CELL > neighbours.PROBES
    assert all(1 <= r.rank <= 10 and r.item != r.query for r in found)


@pytest.mark.parametrize("slice_rows", [neighbours.SLICE, 40])
def test_repeats_clusters_and_odd_vectors(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(neighbours, "SLICE", slice_rows)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12))
    x = np.concatenate([centres[rng.choice(20, 400)] + rng.normal(size=(400, 12)) * 0.2, np.repeat(centres[:1], 150, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (None, x[0].tolist()), (903, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    found = neighbours.neighbours(df, "id", "vector", 5)
    got = as_sets(found.collect())
    assert recall(got, brute(list(range(len(x))), x, 5)) >= 0.9 and not set(got) & {900, 901, 902, 903}
    assert neighbours.neighbours(df.limit(0), "id", "vector", 5).count() == 0


def test_products_are_worked_out_in_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    flat = lambda n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 8, pa.int32()), pa.array(rng.normal(size=n * 8)))
    v, centres = flat(6000), rng.normal(size=(1024, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), v], names=["node", "v"])
    asked, base = pa.table({"node": np.arange(6000), "v": v}), pa.table({"b_node": np.arange(3000) + 6000, "b_v": flat(3000)})
    tracemalloc.start()
    cells = next(neighbours.probed_rows(SimpleNamespace(value=centres), 4)(iter([batch]))).column(2)
    best = neighbours.best_rows(3)(asked, base)
    neighbours.centroids_of(neighbours.unit_matrix(v), 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6  # all products of 6,000 and 3,000 vectors are 144 MB
    unit = neighbours.unit_matrix(v)
    assert cells.to_pylist() == np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :4].tolist()
    near = np.argsort(-(unit @ neighbours.unit_matrix(base.column("b_v")).T), axis=1)[:, :3] + 6000
    assert best.num_rows == 18000 and {(a, b) for a, b in zip(best.column("a").to_pylist(), best.column("b").to_pylist())} == {(i, int(j)) for i, row in enumerate(near) for j in row}
    # small blocks and products give what one group gives
    x = rng.normal(size=(700, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vector array<double>")
    whole = sorted(neighbours.neighbours(df, "id", "vector", 4).collect())
    for name, size in (("BLOCK", 50), ("PRODUCTS", 300), ("SLICE", 60)):
        monkeypatch.setattr(neighbours, name, size)
    assert as_sets(neighbours.neighbours(df, "id", "vector", 4).collect()) == as_sets(whole)
