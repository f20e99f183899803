"""Parameter search on a known surface, and on a small table."""

import numpy as np

from terrane.operators import tuning


def test_search_closes_in_on_the_minimum():
    hits, random_hits = 0, 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        loss = lambda p: float((p[0] - 0.7) ** 2 + (p[1] - 0.2) ** 2)
        points = [rng.random(2) for _ in range(8)]
        for _ in range(22):
            points.append(tuning.next_point(np.array(points), np.array([loss(p) for p in points]), rng))
        hits += min(loss(p) for p in points)
        random_hits += min(loss(p) for p in np.random.default_rng(seed).random((30, 2)))
    assert hits < random_hits


def test_points_stay_in_the_space():
    space = {"depth": (2, 5), "step": (0.01, 0.3)}
    low = tuning.at_point(space, np.array([0.0, 0.0]))
    assert low["depth"] == 2 and np.isclose(low["step"], 0.01)
    top = tuning.at_point(space, np.array([1.0, 1.0]))
    assert top["depth"] == 5 and np.isclose(top["step"], 0.3)


def test_best_trial_repeats_and_beats_the_default(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (400, 2))
    y = np.sin(2 * x[:, 0]) * x[:, 1] + rng.normal(0, 0.05, 400)
    df = spark.createDataFrame([(*map(float, v), float(t), i % 4 == 0) for i, (v, t) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, held boolean").cache()
    space = {"depth": (2, 6), "trees": (3, 12), "step": (0.05, 0.6)}
    one, two = (tuning.tuned(df, ["a", "b"], "y", "held", space, trials=5, startup=3) for _ in range(2))
    assert one.trials == two.trials and one.best_error == min(e for _, e in one.trials)
    default = tuning.error_of(tuning.fit_boosted(df, ["a", "b"], "y", validation="held", trees=3, depth=2), df.where("held"), "y")
    assert one.best_error < default and tuning.error_of(one.model, df, "y") < default
