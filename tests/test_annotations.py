"""Annotation edits, consensus and sample identity on small tables."""

import math

from genoframe.operators import annotate, consensus, filters
from pyspark.sql import functions as F


def test_drop_annotations(spark):
    rows = [(1, "rs1", 5.0, ["PASS"], (3, 0.5), [{"GT": "0/1", "DP": "3"}]), (2, None, None, None, None, [])]
    df = spark.createDataFrame(
        rows, "pos long, id string, qual double, filters array<string>, info struct<DP:int,AF:double>, samples array<map<string,string>>"
    )
    out = annotate.drop_annotations(df, ["ID", "QUAL", "FILTER/PASS", "INFO/DP", "FORMAT/DP"])
    got = {r["pos"]: r for r in out.collect()}
    assert got[1]["id"] is None and got[1]["qual"] is None and got[1]["filters"] is None
    assert got[1]["info"].asDict() == {"AF": 0.5} and got[1]["samples"] == [{"GT": "0/1"}]
    assert got[2]["samples"] == []
    alone = annotate.drop_annotations(df, ["FORMAT", "INFO", "FILTER"])
    assert "info" not in alone.columns and alone.filter("pos = 1").first()["samples"] == [{"GT": "0/1"}]
    assert alone.filter("filters is not null").count() == 0


def test_out_of_frame(spark):
    sites = spark.createDataFrame(
        [(10, "A", ["AT"]), (11, "A", ["ATTT"]), (18, "AAAA", ["A"]), (50, "A", ["AT"]), (12, "A", ["C"])], "pos long, ref string, alts array<string>"
    )
    exons = spark.createDataFrame([(9, 12, 1), (20, 30, 2), (10, 40, 3)], "from1 long, to1 long, name int")
    got = {r["pos"]: r["oof"] for r in annotate.out_of_frame(sites, exons).collect()}
    assert got == {10: 1, 11: 0, 18: 0, 50: -1, 12: -1}


def test_first_gate(spark):
    df = spark.createDataFrame([(1, 5), (50, 5), (50, 99), (None, None)], "q int, d int")
    out = df.select(filters.first_gate([("Q", F.col("q") < 10), ("D", F.col("d") > 50)]).alias("g"))
    assert [r["g"] for r in out.collect()] == ["Q", "-", "D", "-"]


def test_consensus(spark):
    bases = spark.createDataFrame([(1, 1, "A", False), (1, 3, "R", False), (1, 9, "T", True), (1, 12, "C", False), (2, 4, "G", False), (2, 4, "A", False)], "chrom int, pos long, base string, low boolean")
    masks = spark.createDataFrame([(1, 2, 5), (1, 100, 101)], "chrom int, from1 long, to1 long")
    got = {(r["chrom"], r["chunk"]): r["seq"] for r in consensus.consensus(bases, masks, size=10).collect()}
    assert got == {(1, 0): "nAnrnnnnnt", (1, 1): "nnCnnnnnnn", (2, 0): "nnnnGnnnnn"}
    assert consensus.consensus(bases.limit(0), masks, size=10).count() == 0


def test_sample_likelihood(spark):
    pl = spark.createDataFrame([(1, 1, [0.0, 10.0, 20.0]), (2, 1, [10.0, 0.0, 10.0]), (1, 2, [20.0, 10.0, 0.0]), (3, 2, [0.0, 0.0, 0.0])], "pos long, sample int, pl array<double>")
    asked = spark.createDataFrame([(1, 0), (2, 1)], "pos long, dosage int")
    got = {r["sample"]: (r["lk"], r["sites"]) for r in consensus.sample_likelihood(asked, pl).collect()}
    first = -math.log(1 / 1.11) - math.log(1 / 1.2)
    assert abs(got[1][0] - first) < 1e-9 and got[1][1] == 2
    assert abs(got[2][0] + math.log(0.01 / 1.11)) < 1e-9 and got[2][1] == 1
