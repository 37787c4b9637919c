"""Phase ligation against one walk through the files, in order, sample by sample."""

import math
import random

import pytest
from genoframe.operators import sequence


def walked(files, min_quality):
    """{(sample, pos): row}; ``files``: for each file {pos: {sample: (a, b, phased)}}."""
    out, samples = {}, sorted({s for f in files for sites in f.values() for s in sites})
    start = min(min(f) for f in files)
    state = {s: [False, start] for s in samples}

    def give(file, pos, quality=None):
        for s in samples:
            a, b, phased = file[pos][s]
            swap, ps = state[s]
            out[s, pos] = ((b, a) if swap else (a, b)) + (phased or (swap and a is not None), ps, quality and quality[s])

    for k, file in enumerate(files):
        near = lambda f, g: {p for p in f if min(g) <= p <= max(g)}
        shared = sorted(set(file) & set(files[k - 1])) if k else []
        if shared:
            first = shared[(len(shared) + 1) // 2 :]
            quality = {}
            for s in samples:
                same = turned = 0
                for p in shared:
                    (a, b, x), (c, d, y) = files[k - 1][p][s], file[p][s]
                    if None in (a, b, c, d) or not (x and y) or a == b or c == d:
                        continue
                    same, turned = same + ((a, b) == (c, d)), turned + ((a, b) == (d, c))
                match, mism = (turned, same) if state[s][0] else (same, turned)
                state[s][0] = mism > match
                f = match / (match + mism) if match and mism else None
                quality[s] = 99 if f is None else int(99 * (0.7 + f * math.log(f) + (1 - f) * math.log(1 - f)) / 0.7)
                if quality[s] < min_quality and first:
                    state[s][1] = first[0]
            for p in first:
                give(file, p, quality if p == first[0] else None)
        after = sorted(set(file) & set(files[k + 1])) if k + 1 < len(files) else []
        apart = set(file) - (near(file, files[k - 1]) if k else set()) - (near(file, files[k + 1]) if k + 1 < len(files) else set())
        for p in sorted(apart | set(after[: (len(after) + 1) // 2])):
            give(file, p)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_walk_through_the_files(spark, seed):
    rng = random.Random(seed)
    files = []
    for k in range(7):
        sites = [p for p in range(100 * k, 100 * k + rng.choice([90, 130, 170])) if rng.random() < 0.2]
        files.append({p: {s: (rng.choice([0, 1, None]) if rng.random() < 0.1 else rng.randint(0, 1), rng.randint(0, 1), rng.random() < 0.9) for s in ("x", "y")} for p in sites})
    for k in range(1, 7):  # the next file says the same, turned or not, with some noise
        turn = {s: rng.random() < 0.5 for s in ("x", "y")}
        for p in set(files[k]) & set(files[k - 1]):
            for s in ("x", "y"):
                a, b, _ = files[k - 1][p][s]
                files[k][p][s] = (*((b, a) if turn[s] != (rng.random() < 0.3) else (a, b)), rng.random() < 0.95)
    rows = [(s, 1, k, p, *v) for k, f in enumerate(files) for p, sites in f.items() for s, v in sites.items()]
    df = spark.createDataFrame(rows, "sample string, chrom int, chunk int, pos long, a int, b int, phased boolean").repartition(3)
    got = {(r["sample"], r.pos): (r.a, r.b, r.phased, r.phase_set, r.quality) for r in sequence.ligated_rows(df, min_quality=60).collect()}
    assert got == walked(files, 60)


def test_draws_and_missing_overlaps(spark):
    het, turned = (0, 1, True), (1, 0, True)
    files = [{1: het, 5: het}, {5: turned, 9: het}, {20: het, 30: het, 31: het}, {30: het, 31: turned, 40: het}]
    rows = [("x", 1, k, p, *v) for k, f in enumerate(files) for p, v in f.items()]
    df = spark.createDataFrame(rows, "sample string, chrom int, chunk int, pos long, a int, b int, phased boolean")
    got = [(r.swapped, r.quality, r.phase_set) for r in sequence.ligate_phase(df).orderBy("chunk").collect()]
    assert got == [(False, None, 1), (True, 99, 1), (True, None, 1), (False, 0, 31)]  # one site: the first file's; no overlap keeps the state; a draw ends it
    with pytest.raises(ValueError):
        sequence.ligate_phase(spark.createDataFrame([("x", 1, k, p, 0, 1, True) for k in range(3) for p in (1, 50)], df.schema))


@pytest.mark.parametrize("operator", [sequence.ligate_phase, sequence.ligated_rows])
def test_rows_are_worked_out_once(spark, operator):
    rows = [(s, 1, k, p, 0, 1, True) for k in range(4) for p in range(10 * k + 1, 10 * k + 16) for s in (1, 2)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    kind = "sample int, chrom int, chunk long, pos long, a int, b int, phased boolean"
    chunks = spark.createDataFrame(rows, kind).mapInPandas(counted, kind)
    assert operator(chunks).count()
    assert seen.value == len(rows)
