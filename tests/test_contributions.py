"""Contributions to boosted trees against the definition of Shapley values."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import contributions, evaluation, learning

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -x[:, 2]) + rng.normal(size=600) * 0.1
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (600, None, 0.5, None, 1.0, 0.0)], "id int, a double, b double, c double, d double, y double")
    return df, learning.fit_boosted(df, FEATURES, "y", trees=4, depth=4)


def expected_value(node, row, known):
    """What a tree expects of a row when only these features are known."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return expected_value(left if row[split.featureIndex()] <= split.threshold() else right, row, known)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * expected_value(left, row, known) + m * expected_value(right, row, known)) / (n + m)


def by_definition(model, row):
    gbt = model.stages[-1]
    trees = [(t._java_obj.rootNode(), w) for t, w in zip(gbt.trees, gbt.treeWeights, strict=True)]
    worth = {s: sum(w * expected_value(n, row, set(s)) for n, w in trees) for size in range(5) for s in combinations(range(4), size)}
    out = []
    for i in range(4):
        others = [j for j in range(4) if j != i]
        out.append(sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (worth[tuple(sorted((*s, i)))] - worth[s]) for size in range(4) for s in combinations(others, size)))
    return worth[()], out


def test_contributions_are_shapley_values(fitted):
    df, model = fitted
    asked = df.where("id % 60 = 0")
    rows = contributions.with_contributions(model, learning.predict(model, asked, "fitted"), FEATURES).collect()
    assert len(rows) == 11
    for r in rows:
        base, values = by_definition(model, [-1e9 if r[f] is None else r[f] for f in FEATURES])
        assert r.base_value == pytest.approx(base) and [c.name for c in r.contributions] == FEATURES
        assert [c.value for c in r.contributions] == pytest.approx(values, abs=1e-9)


def test_contributions_add_up_on_every_row(fitted):
    df, model = fitted
    told = contributions.with_contributions(model, learning.predict(model, df, "fitted"), FEATURES)
    gap = F.abs(F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["value"]) - F.col("fitted"))
    assert told.agg(F.max(gap)).first()[0] < 1e-9
    top = told.where("id = 0").select(evaluation.drivers(F.col("contributions"), 2, 0.0).alias("d"), "contributions").first()
    assert [d.name for d in top.d] == [c.name for c in sorted(top.contributions, key=lambda c: (-abs(c.value), c.name))[:2]]
    assert contributions.with_contributions(model, df.limit(0), FEATURES).count() == 0
