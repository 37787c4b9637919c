"""The chain against enumeration of all ways, with a map and without; emissions against plain arithmetic."""

import itertools

import numpy as np
import pytest
from genoframe.operators import homozygosity as hz
from pyspark.sql import functions as F


def crossing(points, start, end):
    """Plain lookup among (pos, cm): between the points around ``start`` and ``end``, scaled to 1 at the last."""
    if points is None:
        return (end - start + 1) * 1e-8
    i = max((k for k, p in enumerate(points) if p[0] <= start), default=0)
    j = min((k for k, p in enumerate(points) if p[0] >= end), default=len(points) - 1)
    if i >= j:
        return 0.0
    (x, c), (y, d) = points[i], points[j]
    return (d - c) / points[-1][1] / (y - x) * (min(end, y) - max(start, x))


def enumerated(pos, emit, points, to_az, to_hw):
    """The likeliest states and the chances of state 1, over all ways."""
    weight = {}
    for way in itertools.product((0, 1), repeat=len(pos)):
        total = 0.0
        for before in (0, 1):
            p, at, s0 = 0.5, pos[0] - 1, before
            for t, s in enumerate(way):
                c = crossing(points, at, pos[t])
                turn = (to_az, to_hw)[s0]
                p *= (turn * c if s != s0 else (1 - turn) * (1 - c)) * emit[t][s]
                at, s0 = pos[t], s
            total = total + p
        weight[way] = total
    chance = [sum(p for w, p in weight.items() if w[t]) / sum(weight.values()) for t in range(len(pos))]
    return weight, chance


@pytest.mark.parametrize("with_map", [False, True])
def test_equals_enumeration_for_any_chunk(spark, with_map):
    rng = np.random.default_rng(5)
    points = [(1, 2, 0.0), (1, 90, 3.0), (1, 95, 3.0), (1, 500, 40.0), (1, 800, 41.0), (2, 100, 1.0), (2, 140, 9.0)]
    rows, want = [], {}
    for sample, chrom in ((1, 1), (1, 2), (2, 1), (3, 2)):
        pos = np.sort(rng.choice(np.arange(3, 900), 9, replace=False)).tolist()
        emit = rng.uniform(0.01, 1, (9, 2)).tolist()
        own = [(p, cm) for c, p, cm in points if c == chrom] if with_map else None
        weight, chance = enumerated(pos, emit, own, 0.2, 0.3)
        best = max(weight, key=weight.get)
        want |= {(sample, chrom, p): (s, c) for p, s, c in zip(pos, best, chance)}
        rows += [(sample, chrom, p, float(h), float(a)) for p, (h, a) in zip(pos, emit)]
    rows += [(9, 1, 5, None, None)] + ([(9, 7, 5, 0.5, 0.5)] if with_map else [])  # says nothing; a contig without points
    df = spark.createDataFrame(rows, "sample int, chrom int, pos long, p_hw double, p_az double").repartition(3)
    gm = spark.createDataFrame(points, "chrom int, pos long, cm double") if with_map else None
    for chunk in (7, 100, 10**6):
        got = {(r["sample"], r.chrom, r.pos): (r.state, r.p_az) for r in hz.homozygous_runs(df, to_az=0.2, to_hw=0.3, genetic_map=gm, chunk=chunk).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[k][1] - want[k][1]) for k in want) < 1e-9
        assert [k for k in want if got[k][0] != want[k][0] and abs(want[k][1] - 0.5) > 0.35] == []


def test_best_way_is_the_likeliest(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7):
        pos, emit = np.sort(rng.choice(10**7, n, replace=False)).tolist(), rng.uniform(0.001, 1, (n, 2)).tolist()
        ways = {}
        for way in itertools.product((0, 1), repeat=n):  # the state before the first site is chosen with the way
            ways[way] = max(_one(pos, emit, (b, *way)) for b in (0, 1))
        df = spark.createDataFrame([(1, 1, p, h, a) for p, (h, a) in zip(pos, emit)], "sample int, chrom int, pos long, p_hw double, p_az double")
        got = hz.homozygous_runs(df, to_az=0.4, to_hw=0.5, chunk=10**6).orderBy("pos").collect()
        assert tuple(r.state for r in got) == max(ways, key=ways.get)


def _one(pos, emit, way):
    p, at = 0.5, pos[0] - 1
    for t in range(len(pos)):
        c = (pos[t] - at + 1) * 1e-8
        turn = (0.4, 0.5)[way[t]]
        p *= (turn * c if way[t + 1] != way[t] else (1 - turn) * (1 - c)) * emit[t][way[t + 1]]
        at = pos[t]
    return p


def test_frozen_stretch_does_not_lose_the_other_state(spark):
    """Without crossing-overs the evidence for one state may pass 1e-308 and still be turned."""
    rows = [(1, 1, k, 1.0, 1e-9) for k in range(1, 61)] + [(1, 1, k, 1e-9, 1.0) for k in range(61, 200)]
    df = spark.createDataFrame(rows, "sample int, chrom int, pos long, p_hw double, p_az double")
    flat = spark.createDataFrame([(1, 1, 1.0), (1, 300, 1.0)], "chrom int, pos long, cm double")
    assert {r.state for r in hz.homozygous_runs(df, genetic_map=flat, chunk=50).collect()} == {1}


def test_emissions(spark):
    rows = [
        ([0, 10, 20], [0.7, 0.3]),
        ([20, 10, 0], [0.7, 0.3]),
        ([30, 0, 30], [0.5, 0.5]),
        ([0, 0, 0], [0.5, 0.5]),
        ([5, None, 0], [0.5, 0.5]),
        ([0, 10], [0.5, 0.5]),
        ([40, 30, 20, 10, 0, 50], [0.5, 0.3, 0.2]),  # 1/2
        ([40, 30, 20, 10, 9, 0], [0.5, 0.3, 0.2]),  # 2/2: REF and the second ALT
        ([0, 30, 20, 10, 9, 5], [0.5, 0.3, 0.2]),  # 0/0: REF and the first ALT
        ([0], [1.0]),
    ]
    got = [r.e for r in spark.createDataFrame([([None if x is None else float(x) for x in pl], af) for pl, af in rows], "pl array<double>, af array<double>").select(hz.likelihood_emissions(F.col("pl"), F.col("af")).alias("e")).collect()]

    def plain(pl, af, j, k):
        p = [10 ** (-x / 10) for x in pl]
        at = lambda a, b: p[max(a, b) * (max(a, b) + 1) // 2 + min(a, b)] / sum(p)
        r, a = af[j], af[k]
        return at(j, j) * r * r + 2 * at(j, k) * r * a + at(k, k) * a * a, at(j, j) * r + at(k, k) * a

    for k, pair in {0: (0, 1), 1: (0, 1), 2: (0, 1), 6: (1, 2), 7: (0, 2), 8: (0, 1)}.items():
        assert tuple(got[k]) == pytest.approx(plain(*rows[k], *pair))
    assert [got[k] for k in (3, 4, 5, 9)] == [None] * 4
    af = F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1))
    calls = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 1), (None, 1)], "a int, b int").select(hz.genotype_emissions(F.col("a"), F.col("b"), af, 20.0).alias("e"))
    e, want = 0.01, []
    for (rr, ra, aa), r, a in [((1 - 2 * e, e, e), 0.6, 0.3), ((e, 1 - 2 * e, e), 0.6, 0.3), ((e, e, 1 - 2 * e), 0.6, 0.3), ((e, e, 1 - 2 * e), 0.6, 0.1), ((e, 1 - 2 * e, e), 0.3, 0.1)]:
        want.append((rr * r * r + 2 * ra * r * a + aa * a * a, rr * r + aa * a))
    shown = [r.e for r in calls.collect()]
    assert [tuple(x) for x in shown[:5]] == [pytest.approx(w) for w in want] and shown[5] is None


def test_frequency_sources(spark):
    row = spark.range(1).select(
        hz.frequencies_of_tag(F.array(F.lit(0.25), F.lit(0.5)), F.lit(2)).alias("tag"),
        hz.frequencies_of_tag(F.array(F.lit(0.25)), F.lit(2)).alias("short"),
        hz.frequencies_of_counts(F.lit(8), F.array(F.lit(2), F.lit(1))).alias("counts"),
        hz.frequencies_of_counts(F.lit(0), F.array(F.lit(0))).alias("none"),
        hz.frequencies_of_genotypes(F.array(F.lit(0), F.lit(1), F.lit(None).cast("int"), F.lit(1), F.lit(2)), F.lit(2)).alias("gt"),
    )
    r = row.first()
    assert (r.tag, r.short, r.counts, r.none, r.gt) == ([0.25, 0.25, 0.5], None, [0.625, 0.25, 0.125], None, [0.25, 0.5, 0.25])
