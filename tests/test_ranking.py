"""Listwise ranking: gradients against finite differences of pairs, boxes against Spark's trees, NDCG against a pointwise ranker."""

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import learning, ranking
from terrane.operators.retrieval import ranked, ranking_metrics


def test_pushes_equal_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, k = int(rng.integers(1, 15)), int(rng.integers(1, 6))
        score, grade = rng.integers(-2, 3, n).astype(float), rng.integers(0, 4, n).astype(float)
        order = sorted(range(n), key=lambda i: -score[i])
        place = {i: r for r, i in enumerate(order)}
        disc = lambda i: 1 / np.log2(place[i] + 2) if place[i] < k else 0.0  # noqa: B023, E731
        best = sum(g / np.log2(r + 2) for r, g in enumerate(sorted(2**grade - 1, reverse=True)[:k]))
        gradient, curvature = np.zeros(n), np.zeros(n)
        for i in range(n):
            for j in range(n):
                if grade[i] > grade[j] and best > 0:
                    weight = (2 ** grade[i] - 2 ** grade[j]) * abs(disc(i) - disc(j)) / best
                    rho = 1 / (1 + np.exp(score[i] - score[j]))
                    gradient[i] += weight * rho
                    gradient[j] -= weight * rho
                    curvature[i] += weight * rho * (1 - rho)
                    curvature[j] += weight * rho * (1 - rho)
        got = ranking.pushes(score, grade, k)
        assert np.allclose(got[0], gradient) and np.allclose(got[1], curvature)
    assert all(len(x) == 0 for x in ranking.pushes(np.zeros(0), np.zeros(0), 5))


def graded(spark):
    """Few rows of a query are good; one feature tells these from the next best, the other the many bad ones apart."""
    rng = np.random.default_rng(6)
    rows = []
    for q in range(60):
        for i in range(60):
            top = i < 6
            fine, coarse = rng.normal(), rng.normal()
            grade = (3 if fine > 0 else 2) if top else (1 if coarse > 0 else 0)
            rows.append((q, i, grade, float(fine + rng.normal() * 0.3), float(coarse + (2 if top else 0) + rng.normal() * 0.3), float(rng.normal() + 1.2 * top), None if i % 17 == 5 else float(rng.normal())))
    return spark.createDataFrame(rows, "query int, item int, grade int, fine double, coarse double, hint double, noise double")


def test_listwise_beats_pointwise_on_held_out_queries(spark):
    features = ["fine", "coarse", "hint", "noise"]
    df = graded(spark).repartition(4)
    train, held = df.where("query % 3 > 0"), df.where("query % 3 = 0")
    model = ranking.fit_listwise(train, "query", "item", "grade", features, trees=8, depth=3, step=0.3)
    pointwise = learning.fit_boosted(train, features, "grade", trees=8, depth=3, step=0.3)

    def ndcg(rows):
        out = ranking_metrics(ranked(rows, "query", F.col("score"), "item"), "query", "grade", 10, good=3)
        return out.agg(F.avg("ndcg")).first()[0]

    listwise, plain = ndcg(ranking.with_scores(model, held)), ndcg(learning.predict(pointwise, held, "score"))
    assert listwise > plain and listwise > 0.6
    again = ranking.fit_listwise(train.repartition(7), "query", "item", "grade", features, trees=2, depth=3, step=0.3)
    assert all(np.allclose(a[1], b[1]) for a, b in zip(again.trees, model.trees, strict=False))
    assert ranking.with_scores(model, held.limit(0)).count() == 0
