"""Maps against the same rounds in numpy, and scores against plain distances."""

import numpy as np
import pytest
from genoframe.operators import som, stats
from pyspark.sql import functions as F


def drawn(n=240):
    rng = np.random.default_rng(7)
    good = rng.random(n) < 0.6
    x = np.where(good[:, None], rng.normal([3, -1, 0.2], [0.4, 0.2, 0.05], (n, 3)), rng.uniform([0, -3, 0], [9, 3, 1], (n, 3)))
    return [(k, x[k].tolist(), bool(good[k]), k % 3) for k in range(n)]


def trained(x, side, rounds, units):
    grid = [(i, j) for i in range(side) for j in range(side)]
    for t in range(rounds):
        radius = max(0.5, side / 2 * (1 - t / rounds))
        hit = [int(((units - v) ** 2).sum(axis=1).argmin()) for v in x]
        new = []
        for u, g in enumerate(grid):
            w = np.array([np.exp(-((g[0] - grid[h][0]) ** 2 + (g[1] - grid[h][1]) ** 2) / (2 * radius**2)) for h in hit])
            new.append((w[:, None] * x).sum(axis=0) / w.sum())
        units = np.array(new)
    return units, np.bincount([int(((units - v) ** 2).sum(axis=1).argmin()) for v in x], minlength=side * side)


@pytest.mark.parametrize("folds", [1, 3])
def test_equals_numpy(spark, folds):
    rows = drawn()
    df = spark.createDataFrame([*rows, (999, None, True, 0), (998, [1.0, None, 2.0], True, 1)], "id long, vector array<double>, good boolean, fold int").repartition(5)
    maps = som.train_maps(df.filter("good"), folds=folds, side=3, rounds=4, seed=5)
    own = [(np.array(v), f) for _, v, g, f in rows if g]
    low, high = (m([v for v, _ in own], axis=0) for m in (np.min, np.max))
    start = np.random.default_rng(5).random((folds, 9, 3))
    for f in range(folds):
        units, count = trained(np.array([(v - low) / (high - low) for v, k in own if folds == 1 or k == f]), 3, 4, start[f])
        assert np.abs(maps.units[f] - units).max() < 1e-9 and np.abs(maps.hits[f] - count / count.max()).max() < 1e-12
    for merge, plain in (("min", np.min), ("max", np.max), ("mean", np.mean)):
        got = {r.id: r.score for r in som.scored(df, maps, merge=merge, least_hits=0.2).collect()}
        for k, v, _, fold in rows:
            x = np.clip((np.array(v) - low) / (high - low), 0, 1)
            far = [np.sqrt(((maps.units[f][maps.hits[f] > 0.2] - x) ** 2).sum(axis=1)).min() for f in range(folds) if folds == 1 or f != fold]
            assert got[k] == pytest.approx(1 - plain(far) / np.sqrt(3), abs=1e-9)
        assert got[999] is None


def test_folds_tell_good_from_bad(spark):
    df = spark.createDataFrame(drawn(600), "id long, vector array<double>, good boolean, fold int").withColumn("fold", som.fold_of(F.col("id"), 4))
    maps = som.train_maps(df.filter("good"), folds=4, side=4, rounds=6)
    curve = stats.roc(som.scored(df, maps, merge="mean", least_hits=0.1).select("score", "good"), size=0.25).collect()
    best = max(r.true_rate - r.false_rate for r in curve)
    assert best > 0.6 and max(r.goods for r in curve) == df.filter("good").count()
    with pytest.raises(ValueError):
        som.train_maps(df.limit(0))
