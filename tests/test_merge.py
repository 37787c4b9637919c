"""Merging files record by record: nothing is lost, and which records meet."""

import random

import pyarrow as pa
import pytest
from genoframe.functions import genetics as gen
from genoframe.operators import merge
from pyspark.sql import functions as F

KIND = "pos long, line int, ref string, alts array<string>, samples array<struct<sample:string,gt:array<int>,pl:array<int>>>"


def file(spark, rows):
    df = spark.createDataFrame([r if len(r) == 5 else (*r, None) for r in rows], KIND)
    more = {"id": F.lit(None).cast("string"), "qual": F.lit(None).cast("double"), "filter": F.lit("PASS")}
    return df.withColumns(more).withColumn("mask", gen.type_mask(F.col("ref"), F.col("alts")))


def merged(spark, files, mode, **more):
    out = merge.merge_files([file(spark, f) for f in files], {}, mode, [1] * len(files), order="line", sample_vectors={"pl": "G"}, **more)
    return out.orderBy("pos", "row").collect()


def one(name, gt, pl=None):
    return [(name, gt, pl)]


def test_two_records_of_a_file_keep_their_genotypes(spark):
    files = [[(1, 0, "A", ["C"], one("x", [0, 1])), (1, 1, "A", ["G"], one("x", [1, 1]))], [(1, 0, "A", ["C"], one("y", [1, 1]))]]
    rows = [(r.ref, r.alts, [s.gt for s in r.samples]) for r in merged(spark, files, "both", recount=True)]
    assert rows == [("A", ["C"], [[0, 1], [1, 1]]), ("A", ["G"], [[1, 1], [None, None]])]
    assert [(r.an, r.ac) for r in merged(spark, files, "both", recount=True)] == [(4, [3]), (2, [2])]


def test_mode_none_joins_records_that_share_an_alt(spark):
    files = [[(1, 0, "A", ["C"], one("x", [0, 1]))], [(1, 0, "A", ["G", "C"], one("y", [1, 2]))], [(1, 0, "A", ["T"], one("z", [1, 1]))]]
    rows = [(r.alts, [s.gt for s in r.samples]) for r in merged(spark, files, "none")]
    assert rows == [(["C", "G"], [[0, 1], [2, 1], [None, None]]), (["T"], [[None, None], [None, None], [1, 1]])]
    assert len(merged(spark, files, "both")) == len(merged(spark, files, "all")) == 1


def test_alleles_are_trimmed_and_snps_stay_apart_from_indels(spark):
    files = [[(1, 0, "GTTT", ["GTT"], one("x", [0, 1]))], [(1, 0, "G", ["C"], one("y", [1, 1])), (1, 1, "GT", ["G"], one("y", [0, 0]))]]
    assert [(r.ref, r.alts) for r in merged(spark, files, "both")] == [("GT", ["G"]), ("G", ["C"])]
    assert [(r.ref, r.alts) for r in merged(spark, files, "all")][0] == ("GT", ["G", "CT"])


def test_the_commonest_allele_chooses_after_the_first_round(spark):
    files = [[(1, 0, "A", ["C"]), (1, 1, "A", ["G"]), (1, 2, "A", ["T"])], [(1, 0, "A", ["C"]), (1, 1, "A", ["T"])], [(1, 0, "A", ["T"])]]
    assert [r.alts for r in merged(spark, files, "both")] == [["C", "T"], ["T"], ["G"]]
    assert merge.assigned([0, 0, 1], [1, 1, 1], ["A"] * 3, [["C"], ["G"], ["C"]], "none") == [(0, 0), (1, 1), (0, 0)]
    assert merge.assigned([0, 1], [0, 0], ["A", "A"], [[], []], "both") == [(0, 0), (0, 0)]
    assert merge.assigned([0, 1, 1], [2, 0, 1], ["AT", "A", "A"], [["A"], [], ["C"]], "both") == [(0, 0), (0, 0), (1, 1)]
    assert merge.assigned([0, 1], [1, 1], ["A", "C"], [["T"], ["T"]], "all") == [(0, 0), (1, 1)]  # REFs that contradict


@pytest.mark.parametrize("mode", ["none", "snps", "indels", "both", "all"])
def test_no_genotype_and_no_likelihood_is_lost(spark, mode):
    rng = random.Random(mode)
    tail = "ACGTTT"
    files = [[], [], []]
    for pos in range(60):
        for f in range(3):
            for line in range(rng.choice([0, 1, 1, 2, 3])):
                ref = tail[: rng.choice([1, 1, 2, 4])]
                alts = list({rng.choice("CGT") + ref[1:] if rng.random() < 0.5 else "A" + "T" * rng.randint(0, 3) for _ in range(rng.choice([0, 1, 2]))} - {ref})
                ploidy = rng.choice([1, 2])
                n = len(alts) + 1
                gt = [rng.choice([None, *range(n)]) for _ in range(ploidy)]
                files[f].append((pos, line, ref, alts, one(f"{f}.{line}", gt, [rng.randint(0, 99) for _ in range(n if ploidy == 1 else n * (n + 1) // 2)])))
    bare = lambda ref, a: merge._bare(ref, a) if a != ref else "ref"

    def said(ref, alts, gt, pl):
        """The genotype and each likelihood by what alleles say, whatever their numbers."""
        names = ["ref", *[bare(ref, a) for a in alts]]
        n, haploid = len(names), len(gt) == 1
        keys = [(names[j],) if haploid else tuple(sorted((str(names[i]), str(names[j])))) for j in range(n) for i in (range(1) if haploid else range(j + 1))]
        return sorted(str(None if a is None else names[a]) for a in gt), sorted((str(k), v) for k, v in zip(keys, pl) if v is not None)

    want = sorted((pos, s[0][0], *said(ref, alts, s[0][1], s[0][2])) for f in files for pos, _, ref, alts, s in f)
    rows = merged(spark, files, mode)
    got = sorted((r.pos, s.sample, *said(r.ref, r.alts, s.gt, s.pl)) for r in rows for s in r.samples if s.sample)
    assert got == want
    assert all(len(r.samples) == 3 for r in rows)
    for r in rows:  # widest ploidy for files without the record
        widest = max((len(s.gt) for s in r.samples if s.sample), default=0)
        assert all(s.gt == [None] * widest and s.pl is None for s in r.samples if s.sample is None)


def test_sample_names(spark):
    assert merge.merged_sample_names([["a", "b"], ["c"]]) == ["a", "b", "c"]
    assert merge.merged_sample_names([["a", "b"], ["b"]], force=True) == ["a", "b", "2:b"]
    with pytest.raises(ValueError):
        merge.merged_sample_names([["a"], ["a"]])


def test_numbers_of_a_merged_record_come_with_its_alleles(spark):
    """What renumbers samples and vectors is worked out from the alleles alone, once for equal sites, and not again in each row."""
    files = [[(p, 0, "A", ["C"], one("x", [0, 1])) for p in (1, 2)], [(p, 0, "AT", ["GT", "CT"], one("y", [1, 2])) for p in (1, 2)]]
    rows = merge.merged_records([file(spark, f) for f in files], "both", "line").orderBy("pos").collect()
    assert [(r.pos, r.row, r.ref, r.alts) for r in rows] == [(p, 0, "A", ["C", "G"]) for p in (1, 2)]
    first, second = ([tuple(t) for t in r.taken] for r in rows)
    assert first == second == [(0, [0, 1, None], [0, 1], [0, 1, 2, None, None, None]), (1, [0, 2, 1], [0, 2, 1], [0, 3, 5, 1, 4, 2])]
    assert all(t.g == [] for r in merge.merged_records([file(spark, f) for f in files], "both", "line", genotypes=False).collect() for t in r.taken)
    merge._merged_text.cache_clear()
    sites = pa.array(["0\x1f1\x1fA\x1fC"] * 1000 + [None])
    told = merge._merge("both", True).func(sites)
    assert told[0] == told[999] and not told[1000].is_valid and merge._merged_text.cache_info().currsize == 1
