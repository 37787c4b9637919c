"""The staged filter against one walk through all records of a contig, with no islands and no windows on what is kept."""

import random

import pytest
from genoframe.operators import filters


def alone(r):
    dp, mq, dp4, pv4, mxgq, mxsp, g3, hwe = r[6:]
    letter = "U"
    if dp is not None:
        letter = "d" if dp < 2 else "D" if dp > 60 else "U"
    if dp4 is not None and dp4[2] + dp4[3] < 2:
        letter = "a"
    if letter == "U" and mq is not None and mq < 10:
        letter = "Q"
    if letter == "U" and pv4 is not None and any(x < limit for x, limit in zip(pv4, (1e-4, 1e-100, 0, 1e-4))):
        letter = "P"
    if letter == "U" and ((mxgq is not None and mxgq < 5) or (mxsp is not None and mxsp >= 1000)):
        letter = "M"
    if g3 is not None and hwe is not None and hwe < 1e-4:
        p = 2 * g3[0] + g3[1]
        if 0 < p < 1 and 1 - g3[1] / (p * (1 - p)) < 0:
            letter = "S"
    return letter


def walked(rows, wide, near):
    seen = []
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        chrom, pos, rec, ref, alts, qual, dp4 = *r[:6], r[8]
        if not alts or ref == "N":
            continue
        kind = 3 if any(len(a) != len(ref) for a in alts) else 2 if len(ref) > 1 else 1
        t = {"chrom": chrom, "pos": pos, "rec": rec, "ref": ref, "alt": ",".join(alts), "kind": kind, "rlen": len(ref) - 1, "flag": alone(r), "score": (qual or 0) * 100 + (dp4[2] + dp4[3] if dp4 else -1)}
        before = [x for x in seen if x["chrom"] == chrom]
        within = lambda x, w: x["pos"] + x["rlen"] + w >= pos  # noqa: B023, E731
        if t["flag"] == "U" and kind == 3:
            for x in before:
                if x["kind"] != 3 and x["flag"] == "U" and within(x, near):
                    x["flag"] = "G"
            for x in before:
                if x["kind"] == 3 and x["flag"] == "U" and within(x, wide):
                    if int(x["score"]) < t["score"]:
                        x["flag"] = "g"
                    else:
                        t["flag"] = "g"
                        break
        elif t["flag"] == "U":
            for x in before:
                if x["kind"] == 3 and within(x, near):
                    if x["pos"] + len(x["alt"]) - 1 == pos and x["alt"][-1] == t["alt"][0] and len(x["alt"]) - len(x["ref"]) == 1:
                        x["flag"] = "G"
                    else:
                        t["flag"] = "G"
                    break
            for x in before:
                if x["kind"] != 3 and within(x, 0):
                    if int(x["score"]) < t["score"]:
                        x["flag"] = "M"
                    else:
                        t["flag"] = "M"
                        break
        seen.append(t)
    return {(t["chrom"], t["rec"]): t["flag"] for t in seen}


KIND = "chrom string, pos long, rec long, ref string, alts array<string>, qual double, dp int, mq int, dp4 array<int>, pv4 array<double>, mxgq int, mxsp int, g3 array<double>, hwe double"


@pytest.mark.parametrize("seed, spread", [(0, 2), (1, 5), (2, 14), (3, 60)])
def test_equals_one_walk(spark, seed, spread):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.3 else x
    rows, pos = [], (1 << 20) - 150 * spread // 2  # a range of positions ends in the middle
    for rec in range(300):
        pos += rng.choice([0, 0, 1, rng.randint(1, spread)])
        ref = "".join(rng.choice("AC") for _ in range(rng.choice([1, 1, 1, 2, 3, 5])))
        alts = ["".join(rng.choice("AC") for _ in range(rng.choice([len(ref), len(ref), len(ref), 1, len(ref) + 1]))) for _ in range(rng.choice([1, 1, 2]))]
        alts = [] if rng.random() < 0.03 else alts
        gates = [maybe(rng.choice([1, 5, 30, 30, 30, 99])), maybe(rng.choice([5, 50, 50, 50])), maybe([9, 9, rng.randint(0, 3), rng.randint(1, 9)]), maybe([rng.choice([1e-5, 0.5, 0.5, 0.5]), 0.1, 0.1, 0.1])]
        gates += [maybe(rng.choice([1, 50, 50, 50])), maybe(rng.choice([10, 10, 2000])), maybe([rng.choice([0.1, 0.3]), rng.choice([0.1, 0.6]), 0.3]), maybe(rng.choice([1e-6, 0.5]))]
        rows.append((rng.choice(["1", "2"]) if spread > 5 else "1", pos, rec, "N" if rng.random() < 0.02 else ref, alts, maybe(rng.choice([1.0, 1.004, 1.007, 5.0])), *gates))
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = filters.legacy_gates(df, max_depth=60, min_genotype_quality=5)
    assert {(r.chrom, r.rec): r.letter for r in got.collect()} == walked(rows, 10, 3)


def test_a_beaten_indel_beats_none(spark):
    """The middle one beats the first and is beaten by the third, which the first would have survived."""
    rows = [("1", 10, 0, "A", ["AT"], 1.0), ("1", 18, 1, "A", ["AT"], 2.0), ("1", 26, 2, "A", ["AT"], 3.0), ("1", 34, 3, "A", ["AT"], 2.5), ("1", 100, 4, "A", ["C"], None), ("2", 100, 5, "A", ["C"], 1.0)]
    df = spark.createDataFrame(rows, "chrom string, pos long, rec long, ref string, alts array<string>, qual double")
    assert [r.letter for r in filters.legacy_gates(df).orderBy("rec").collect()] == ["g", "g", "U", "g", "U", "U"]
    assert filters.legacy_gates(df.limit(0)).count() == 0
