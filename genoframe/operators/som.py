"""Self-organising maps of good sites: batch training, folds, scores.

A map is ``side`` x ``side`` units. A round of training is one aggregation: every row goes
to its nearest unit, and of each unit only the number and the sum of its rows come back,
from which all units are set anew. Vectors are scaled to 0 to 1 in every dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genetics import let


@dataclass
class Maps:
    """``units`` (folds, units, dimensions) and ``hits`` (folds, units): the share of the most hit unit's rows."""

    units: np.ndarray
    hits: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _distance2(vector: Column, unit: Column) -> Column:
    return F.aggregate(F.zip_with(vector, unit, lambda a, b: a.cast("double") - b), F.lit(0.0), lambda s, d: s + d * d)


def _literal(values: np.ndarray) -> Column:
    return F.array(*[_literal(v) for v in values]) if values.ndim else F.lit(float(values))


def nearest_unit(rows: DataFrame, units: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Adds ``unit`` (the map unit of least distance, the first of equals) and ``distance2``.

    Units are a trained map of fixed size, part of the plan as literals.
    """
    far = F.transform(_literal(np.asarray(units, float)), lambda u: _distance2(F.col(vector), u))
    return rows.withColumn("_d", far).withColumns({"unit": F.array_position("_d", F.array_min("_d")).cast("int") - 1, "distance2": F.array_min("_d")}).drop("_d")


def fold_of(key: Column, folds: int) -> Column:
    """The fold of a row, by a hash of what names it."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def _scaled(vector: str, low: np.ndarray, high: np.ndarray) -> Column:
    width = np.where(high > low, high - low, 1.0)
    scaled = F.zip_with(F.zip_with(vector, _literal(low), lambda v, b: v.cast("double") - b), _literal(1 / width), lambda v, w: v * w)
    return F.transform(scaled, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def neighbourhood(side: int, radius: float) -> np.ndarray:
    """(units, units): how much a unit follows another, by their distance on the grid."""
    grid = np.array([(i, j) for i in range(side) for j in range(side)])
    return np.exp(-((grid[:, None] - grid[None]) ** 2).sum(axis=2) / (2 * radius**2))


def updated(units: np.ndarray, count: np.ndarray, total: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Units as means of all rows, weighed by nearness to the unit that each row went to; a unit near none stays."""
    weight = near @ count
    return np.where(weight[:, None] > 1e-300, near @ total / np.maximum(weight, 1e-300)[:, None], units)


def train_maps(rows: DataFrame, *, vector: str = "vector", fold: str = "fold", folds: int = 1, side: int = 5, rounds: int = 10, seed: int = 1) -> Maps:
    """A map for each fold from the rows (the good ones) whose ``fold`` it is; with one fold the column is not needed.

    Rows without vector, or with a gap in it, are left out. What comes to the driver is
    ``folds`` x ``side``^2 rows a round. The radius falls from half the side to a half.
    """
    rows = rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull()))
    rows = rows.select(F.col(vector).alias("v"), (F.col(fold) if folds > 1 else F.lit(0)).alias("fold"))
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if not size:
        raise ValueError("no rows to train on")
    each = [F.get("v", F.lit(k)).cast("double") for k in range(size)]
    ends = rows.agg(*[f(c).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k, c in enumerate(each)]).first()
    low, high = (np.array([ends[f"{n}{k}"] for k in range(size)], float) for n in ("lo", "hi"))
    rows = rows.select("fold", _scaled("v", low, high).alias("v"))
    sums = [F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(size)]
    n = side * side
    units = np.random.default_rng(seed).random((folds, n, size))

    def told(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, total = np.zeros((folds, n)), np.zeros((folds, n, size))
        far = let(F.get(_literal(units), F.col("fold")), lambda own: F.transform(own, lambda u: _distance2(F.col("v"), u)))
        hit = let(far, lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)
        for r in rows.select("fold", "v", hit.alias("unit")).groupBy("fold", "unit").agg(F.count("*").alias("n"), *sums).collect():
            count[r.fold, r.unit], total[r.fold, r.unit] = r.n, [r[f"s{k}"] for k in range(size)]
        return count, total

    for t in range(rounds):
        near = neighbourhood(side, max(0.5, side / 2 * (1 - t / rounds)))
        count, total = told(units)
        units = np.stack([updated(units[f], count[f], total[f], near) for f in range(folds)])
    count, _ = told(units)
    return Maps(units, count / np.maximum(count.max(axis=1, keepdims=True), 1), low, high)


def _nearest(units: np.ndarray):
    return lambda v: F.array_min(F.transform(_literal(units), lambda u: _distance2(v, u)))


def scored(rows: DataFrame, maps: Maps, *, vector: str = "vector", fold: str = "fold", merge: str = "min", least_hits: float = 0.0) -> DataFrame:
    """Adds ``score``, 1 at a unit and 0 at the farthest two points of the space.

    The distance to a map is that to its nearest unit with more than ``least_hits`` of
    the most hit unit's rows; ``merge`` takes the ``min``, ``max`` or ``mean`` of the maps
    but the one that the row's fold trained. One map scores all rows. Without vector the score is null.
    """
    folds, _, size = maps.units.shape
    v = _scaled(vector, maps.low, maps.high)
    far = []
    for f in range(folds):
        own = maps.units[f][maps.hits[f] > least_hits]
        nearest = let(v, _nearest(own)) if len(own) else F.lit(None).cast("double")
        far.append(F.when((F.col(fold) != f) if folds > 1 else F.lit(True), F.sqrt(nearest)))
    known = F.array_compact(F.array(*far))
    mean = let(known, lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d))
    distance = {"min": F.array_min(known), "max": F.array_max(known), "mean": F.when(F.size(known) > 0, mean)}[merge]
    return rows.withColumn("score", 1 - distance / float(np.sqrt(size)))
