"""Operators on small tables, against closed forms and plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from genoframe.functions import genetics as gen
from genoframe.operators import calling, filters, genotype, joins, reshape, sequence, stats
from genoframe.sources.vcf import number_text, read_vcf, write_vcf
from genoframe.streaming import events as ev
from pyspark.sql import functions as F


def test_types(spark):
    rows = [("A", ["C"], 1), ("A", ["C", "AT"], 3), ("AC", ["GT"], 4), ("ACC", ["A"], 2), ("A", ["<DEL>"], 8), ("A", [], 0), ("TAGGG", ["CAGGG", "CAGGT"], 5)]
    df = spark.createDataFrame(rows, "ref string, alts array<string>, want int")
    got = df.select("want", gen.type_mask(F.col("ref"), F.col("alts")).alias("m"), gen.type_names(gen.type_mask(F.col("ref"), F.col("alts"))).alias("n")).collect()
    assert [r.m for r in got] == [r.want for r in got]
    assert got[1].n == "SNP,INDEL" and got[5].n == "REF"


def test_scalars(spark):
    r = spark.range(1).select(
        gen.is_transition(F.lit("A"), F.lit("G")).alias("ts"), gen.is_transition(F.lit("A"), F.lit("C")).alias("tv"),
        gen.genotype_index(F.lit(1), F.lit(2)).alias("g"), gen.reverse_complement(F.lit("AACG")).alias("rc"), gen.iupac(F.lit("A"), F.lit("G")).alias("u"),
        gen.log_sum_exp(F.array(F.lit(-1000.0), F.lit(-1000.0))).alias("l"), gen.trim_suffix(F.array(F.lit("GTTT"), F.lit("GTT"))).alias("t"),
    ).first()
    assert (r.ts, r.tv, r.g, r.rc, r.u, r.t) == (True, False, 4, "CGTT", "R", ["GT", "G"])
    assert r.l == pytest.approx(-1000 + math.log(2))


def test_number_text(spark):
    values = [0.0, 1.0, 59.2, 82.7, 0.125, 1e-6, 123456.0, 1234567.0, 3.14159265, -2.5, 100.0, 0.0001]
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").select("k", number_text(F.col("v")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["%g" % v for v in values]


VCF = """##fileformat=VCFv4.2
##contig=<ID=2,length=100>
##contig=<ID=1,length=100>
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="b">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
1\t10\trs1\tA\tC,G\t59.2\tPASS\tDP=5;AF=0.5,0.25;DB\tGT:DP\t0/1:3\t./.:.
2\t7\t.\tAT\tA\t.\tq10;s50\tDP=3\tGT\t0|1\t1
2\t9\t.\tA\t.\t3\t.\t.\tGT:DP\t0/0:1\t0/0
"""


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    header, rows = read_vcf(spark, str(tmp_path / "a.vcf"))
    assert header.samples == ["A", "B"] and header.contigs == ["2", "1"]
    got = {r.pos: r for r in rows.collect()}
    assert got[10].info.DP == 5 and got[10].info.AF == [0.5, 0.25] and got[10].info.DB is True and got[7].info.DB is False
    assert got[7].qual is None and got[7].filters == ["q10", "s50"] and got[9].filters is None and got[9].alts == []
    assert got[10].samples[0] == {"GT": "0/1", "DP": "3"} and got[10].samples[1]["DP"] is None
    write_vcf(header, rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = text.split("\n")
    assert lines[:9] == VCF.split("\n")[:9]
    assert lines[9:12] == [VCF.split("\n")[10], VCF.split("\n")[11] + ":.", VCF.split("\n")[9]]


def test_left_align(spark):
    seq = "GGGCACACACTTT"
    ref = spark.createDataFrame([("1", 0, seq[:5]), ("1", 1, seq[5:10]), ("1", 2, seq[10:])], "chrom string, chunk long, seq string")
    rows = [("1", 1, 9, "AC", ["A"]), ("1", 2, 8, "CAC", ["C"]), ("1", 3, 4, "C", ["T"]), ("1", 4, 12, "TT", ["T"])]
    df = spark.createDataFrame(rows, "chrom string, rec long, pos long, ref string, alts array<string>")
    got = {r.rec: (r.pos, r.ref, r.alts) for r in reshape.left_align(df.filter("rec > 2"), ref, window=5).collect()}
    assert got == {3: (4, "C", ["T"]), 4: (10, "CT", ["C"])}
    wide = spark.createDataFrame([("1", 0, seq)], "chrom string, chunk long, seq string")
    got = {r.rec: (r.pos, r.ref, r.alts) for r in reshape.left_align(df.filter("rec = 2"), wide, window=100).collect()}
    assert got == {2: (3, "GCA", ["G"])}


def test_split_indexes(spark):
    df = spark.createDataFrame([(1, "A", ["C", "G"], "rs", [1, 2], [7, 8, 9], [0, 1, 2, 3, 4, 5])], "pos int, ref string, alts array<string>, id string, a array<int>, r array<int>, g array<int>")
    got = {x.nth: x for x in reshape.split_alleles(df, ["a"], ["r"], ["g"]).collect()}
    assert (got[1].a, got[1].r, got[1].g) == ([1], [7, 8], [0, 1, 2]) and (got[2].a, got[2].r, got[2].g) == ([2], [7, 9], [0, 3, 5])
    assert got[1].id is None


def test_soft_filter(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, ["PASS"]), (3, 5.0, ["a"]), (4, None, ["a"]), (5, 50.0, None), (6, 50.0, ["a"])], "k int, q double, filters array<string>")
    run = lambda **kw: {r.k: r.filters for r in filters.soft_filter(df, F.col("q") > 10, "low", **kw).collect()}
    assert run() == {1: ["low"], 2: ["low"], 3: ["low"], 4: ["low"], 5: ["PASS"], 6: ["a"]}
    assert run(append=True) == {1: ["low"], 2: ["low"], 3: ["a", "low"], 4: ["a", "low"], 5: ["PASS"], 6: ["a"]}
    assert run(reset=True)[6] == ["PASS"]


def test_regions_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(p), int(p + n)) for p, n in zip(rng.integers(1, 8000, 300), rng.integers(0, 1500, 300))]
    regs = [(int(p), int(p + n)) for p, n in zip(rng.integers(1, 9000, 12), rng.integers(0, 300, 12))]
    df = spark.createDataFrame(rows + rows[:5], "a long, b long")
    got = joins.select_regions(df, spark.createDataFrame(regs, "from1 long, to1 long"), start=F.col("a"), end=F.col("b"), bin_size=100).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows + rows[:5] if any(r[0] <= y and r[1] >= x for x, y in regs))


def test_missing_genotypes(spark):
    df = spark.createDataFrame([(1, 1, None, None, 3, 1.0, True), (1, 2, 0, 1, 4, 1.0, True)], "pos int, sample int, a int, b int, dp int, gq double, phased boolean")
    m = genotype.matrix(df)
    r = m.select(genotype.allele_number(F.col("samples")).alias("an"), F.transform("samples", genotype.dosage).alias("d"), genotype.set_missing_to_ref(F.col("samples")).alias("s")).first()
    assert r.an == 2 and r.d == [-1, 1] and (r.s[0].a, r.s[0].phased, r.s[1].phased) == (0, False, True)


def test_caller_prefers_supported_alleles():
    prob = np.array([[1, 1e-9, 1e-9], [1e-9, 1, 1e-9], [1e-9, 1e-9, 1]])
    prob /= prob.sum(axis=1, keepdims=True)
    keep, quality, calls = calling.site_kernel(prob, np.array([0.5, 0.5]))
    assert keep == [0, 1] and quality > 50 and calls == [(0, 0), (0, 1), (1, 1)]
    keep, _, calls = calling.site_kernel(np.array([[1.0, 1e-6, 1e-9]] * 3), np.array([0.9, 0.1]))
    assert keep == [0] and calls == [(0, 0)] * 3
    assert calling.site_kernel(np.zeros((2, 3)), np.array([0.5, 0.5]))[2] == [(-1, -1)] * 2


def test_em_finds_frequency(spark):
    g = [(1, 1.0, 0.0, 0.0)] * 6 + [(1, 0.0, 1.0, 0.0)] * 2 + [(1, 0.0, 0.0, 1.0)] * 2
    r = calling.allele_frequency_em(spark.createDataFrame(g, "k int, g0 double, g1 double, g2 double"), "k").first()
    assert r.af == pytest.approx(0.3) and r.samples == 10


def test_concordance_and_merge(spark):
    g = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 0), (2, 1, 1, 1)], "pos int, sample int, a int, b int")
    r = stats.concordance(g, g.withColumn("a", F.when(F.col("pos") == 2, 0).otherwise(F.col("a"))), []).first()
    assert (r.rr, r.ra, r.aa, r.mismatch, r.nrd) == (1, 1, 0, 1, 50.0)


def test_stream_equals_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    stream = ev.read_stream(spark, "/root/testdata/sf0.001", table.schema, "events.parquet")
    ev.run_to_table(ev.tumbling(stream), "hours", str(tmp_path / "c1"), "complete")
    want = sorted(map(tuple, ev.tumbling(table.withColumn("ts", F.col("ts").cast("timestamp"))).select("start", "event_type", "n").collect()))
    assert sorted(map(tuple, spark.table("hours").select("start", "event_type", "n").collect())) == want


def test_concordance_by_frequency_reads_each_set_once(spark):
    """As the joins of both sets would have it, with repeated samples and missing alleles, but without a join."""
    rng = random.Random(8)
    drawn = lambda n: [(rng.randrange(2), rng.randrange(12), rng.randrange(5), *(rng.choice([0, 0, 1, 1, None]) for _ in "ab")) for _ in range(n)]
    left, right = (spark.createDataFrame(drawn(150), "chrom int, pos long, sample int, a int, b int") for _ in "xy")
    af = left.groupBy("chrom", "pos").agg((F.sum(F.col("a") + F.col("b")) / (2 * F.count("*"))).alias("af"))
    at = af.select("chrom", "pos", F.least(F.floor(F.col("af") * 10), F.lit(9)).cast("int").alias("bin"))
    classes = stats.concordance(left.join(at, ["chrom", "pos"]), right, ["bin"])
    r2 = stats.dosage_r2(left, right).join(at, ["chrom", "pos"]).groupBy("bin").agg(F.avg("r2").alias("r2"), F.count("*").alias("sites"))
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    want = rows(classes.join(r2, "bin"))
    out = stats.concordance_by_frequency(left, right)
    assert len(want) > 3 and rows(out) == want == rows(stats.concordance_by_frequency(left, right, af))
    assert "Join" not in out._jdf.queryExecution().toString()


def test_report_counts_sites_in_one_pass(spark):
    """Sets without SNPs, records without ALT, unknown quality and frequency: as counted section by section, from one reading of the sites."""
    alts = F.expr("element_at(array(array('C'), array('G', 'AT'), array('ATT'), cast(array() as array<string>), array('C', '<DEL>'), array('T')), cast(id % 6 + 1 as int))")
    sites = spark.range(60).withColumns({"alts": alts, "ref": F.lit("A"), "set": F.when(F.col("id") % 6 == 2, "gaps").otherwise("rest"), "qual": F.expr("if(id % 7 = 0, null, id * 40.0D)")})
    sites = sites.withColumns({"mask": gen.type_mask(F.col("ref"), F.col("alts")), "ac": F.expr("transform(alts, (a, k) -> cast(if(id % 5 = 0, null, id % 5 - 1) as long))"), "an": F.expr("if(id % 4 = 0, 0, 8)"), "depth": F.expr("if(id % 3 = 0, null, id)")})
    out = stats.report(sites.drop("id").withColumnRenamed("set", "id"), n_samples=2, user={"depth": (0, 60, 7)})
    got = {}
    for r in out.filter("row not like '#%'").collect():
        got.setdefault(r.section, set()).add(tuple(r.row.split("\t")))
    named = sites.drop("id").withColumnRenamed("set", "id")
    s = {r.id: r for r in stats.summary(named, "id").collect()}
    keys = {"SNPs": "snps", "MNPs": "mnps", "indels": "indels", "others": "others", "multiallelic sites": "multiallelic", "multiallelic SNP sites": "multiallelic_snps"}
    assert got["SN"] == {(i, f"number of {k}:", str(r[c])) for i, r in s.items() for k, c in keys.items()} | {(i, "number of samples:", "2") for i in s}
    t = {r.id: r for r in stats.tstv(named, "id").collect()}
    assert {x[:3] + x[4:6] for x in got["TSTV"]} == {("gaps", "0", "0", "0", "0"), *[(i, *(str(r[c]) for c in ("ts", "tv", "ts_first", "tv_first"))) for i, r in t.items()]}
    for i in s:
        lengths = stats.indel_lengths(named.filter(F.col("id") == i).withColumn("alts", F.expr("filter(alts, a -> a <> '<DEL>')"))).collect()
        assert {x[1:] for x in got["IDD"] if x[0] == i} == {(str(r.length), str(r.n)) for r in lengths}
        twelve = stats.substitutions(spark, named.filter(F.col("id") == i)).collect()
        assert {x[1:] for x in got["ST"] if x[0] == i} == {(f"{r.ref}>{r.alt}", str(r.n)) for r in twelve}
        user = stats.user_tstv(named.filter((F.col("id") == i) & F.col("depth").isNotNull()), F.col("depth"), 0, 60, 7).collect()
        assert {x[1:] for x in got.get("USR:depth", ()) if x[0] == i} == {(f"{10.0 * r.bin:e}", str(r.ts + r.tv), str(r.ts), str(r.tv)) for r in user}
        levels = stats.quality_histogram(named.filter((F.col("id") == i) & (F.col("mask").bitwiseAND(gen.SNP | gen.INDEL) != 0))).collect()
        assert {x[1] for x in got["QUAL"] if x[0] == i} == {str(r.qual_bin) for r in levels}
    alleles = named.filter("exists(alts, a -> a <> '<DEL>')").count() + named.filter("mask = 3").count()
    assert sum(int(x[2]) + int(x[5]) for x in got["AF"]) == alleles
    assert [len([x for x in got["SiS"] if x[0] == i]) for i in s] == [1, 1]
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
