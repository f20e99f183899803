"""Search for the parameters of boosted trees by Parzen estimators, with early stopping and a refit of the best.

The first trials are drawn at random. From then on the trials so far are split into the better quarter and the rest;
each half's parameters are smoothed into a density, points are drawn from the density of the better ones, and the one
that is likeliest under these against the rest is tried next. Each trial is a Spark ML fit on rows without the
validation flag and an error on those with it; the driver holds one number for each trial. Draws depend on the seed
and the errors alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.learning import fit_boosted, predict

#: Share of the trials that count as the better ones, points that are drawn for each next trial.
BETTER, DRAWN = 0.25, 24
WHOLE = {"depth", "trees"}


@dataclass
class Tuned:
    best: dict[str, float]
    best_error: float
    model: PipelineModel
    trials: list[tuple[dict[str, float], float]] = field(default_factory=list)


def density(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log density of normals around the points of a unit interval and a uniform one, as wide as points are apart."""
    width = np.clip(1.06 * (points.std() + 0.05) * len(points) ** -0.2, 0.05, 0.5)
    normals = np.exp(-0.5 * ((at[:, None] - points[None]) / width) ** 2) / (width * np.sqrt(2 * np.pi))
    return np.log((normals.sum(axis=1) + 1) / (len(points) + 1))


def next_point(tried: np.ndarray, errors: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Where to try next, in the unit cube of the parameters."""
    order = np.argsort(errors, kind="stable")
    n = max(2, int(np.ceil(BETTER * len(order))))
    good, rest = tried[order[:n]], tried[order[n:]]
    drawn = np.clip(good[rng.integers(0, len(good), DRAWN)] + rng.normal(0, 0.15, (DRAWN, tried.shape[1])), 0, 1)
    worth = sum(density(good[:, i], drawn[:, i]) - density(rest[:, i], drawn[:, i]) for i in range(tried.shape[1]))
    return drawn[int(np.argmax(worth))]


def at_point(space: dict[str, tuple[float, float]], point: np.ndarray) -> dict[str, float]:
    """The parameters at a point of the unit cube; those that are not whole numbers on a scale of logs."""
    out = {}
    for (name, (low, high)), u in zip(space.items(), point.tolist(), strict=True):
        out[name] = int(min(high, low + np.floor(u * (high - low + 1)))) if name in WHOLE else float(np.exp(np.log(low) + u * (np.log(high) - np.log(low))))
    return out


def error_of(model: PipelineModel, rows: DataFrame, label: str) -> float:
    return float(predict(model, rows, "__fitted").agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("__fitted"), 2)))).first()[0])


def tuned(df: DataFrame, features: list[str], label: str, validation: str, space: dict[str, tuple[float, float]], trials: int = 20, startup: int = 6, seed: int = 11, patience: int = 8) -> Tuned:
    """Parameters of fit_boosted from `space` (name: low, high) with the smallest error on rows of the validation flag,
    and a model of them on all rows. Growth stops early on the flag in each trial, and the search after `patience`
    trials without a better one."""
    rng, held = np.random.default_rng(seed), df.where(validation)
    points, found = [], []
    for number in range(trials):
        point = rng.random(len(space)) if number < startup or number < 3 else next_point(np.array(points), np.array([e for _, e in found]), rng)
        chosen = at_point(space, point)
        error = error_of(fit_boosted(df, features, label, validation=validation, **chosen), held, label)
        points.append(point)
        found.append((chosen, error))
        if number + 1 - min(range(len(found)), key=lambda i: found[i][1]) > patience:
            break
    best, error = min(found, key=lambda t: t[1])
    return Tuned(best, error, fit_boosted(df, features, label, **best), found)
