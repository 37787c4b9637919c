"""Readers of side tables on small files."""

from genoframe.operators import reshape
from genoframe.sources import tables


def test_regions_in_all_formats(spark, tmp_path):
    (tmp_path / "a.tab").write_text("# x\n1\t10\t20\n2 7\n")
    (tmp_path / "a.bed").write_text("1\t9\t20\n2\t6\t7\n")
    (tmp_path / "a.vcf").write_text("##fileformat\n#CHROM\n1\t10\t.\tACGTACGTACG\tA\n2\t7\t.\tA\tC\n")
    want = [("1", 10, 20), ("2", 7, 7)]
    for kind in ("tab", "bed", "vcf"):
        assert sorted(map(tuple, tables.read_regions(spark, str(tmp_path / f"a.{kind}"), kind).collect())) == want


def test_targets_pedigree_and_map(spark, tmp_path):
    (tmp_path / "t").write_text("1\t5\tA,C,G\n")
    assert tables.read_target_alleles(spark, str(tmp_path / "t")).first()["alleles"] == ["A", "C", "G"]
    (tmp_path / "p").write_text("f a 0 0 1 0\nf b 0 0 2 0\nf c a b 1 0\nshort line\n")
    people = tables.read_pedigree(spark, str(tmp_path / "p"))
    assert people.count() == 3
    assert [tuple(r) for r in tables.trios(people).collect()] == [("f", "a", "b", "c")]
    (tmp_path / "m").write_text("position COMBINED_rate(cM/Mb) Genetic_Map(cM)\n100 1.0 0.5\n200 1.0 0.75\n")
    assert [tuple(r) for r in tables.read_genetic_map(spark, str(tmp_path / "m"), "7").orderBy("pos").collect()] == [("7", 100, 0.5), ("7", 200, 0.75)]


def test_fasta_serves_alignment(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">1 first\nACGTTTTT\nTTGC\n>2\nac\n>3\n\n")
    chunks = tables.read_fasta(spark, str(tmp_path / "r.fa"), chunk=5)
    got = {(r["chrom"], r["chunk"]): r["seq"] for r in chunks.collect()}
    assert got == {("1", 0): "ACGTT", ("1", 1): "TTTTT", ("1", 2): "GC", ("2", 0): "AC"}
    sites = spark.createDataFrame([("1", 1, 9, "TT", ["T"])], "chrom string, rec long, pos long, ref string, alts array<string>")
    out = reshape.left_align(sites, tables.read_fasta(spark, str(tmp_path / "r.fa"), chunk=12), window=12).first()
    assert (out["pos"], out["ref"], out["alts"]) == (3, "GT", ["G"])


def test_snp_table(spark):
    rows = [("1", 9, "rs1", "+", "A", "A/G"), ("1", 19, "rs2", "-", "A", "T/C"), ("1", 29, "rs3", "+", "-", "-/AC"), ("1", 39, "rs4", "+", "A", "A"), ("1", 49, None, "+", "AC", "-/AC")]
    df = spark.createDataFrame(rows, "chrom string, start long, name string, strand string, ref string, observed string")
    got = sorted((r["pos"], r["ref"], r["alts"]) for r in tables.sites_of_snp_table(df).collect())
    assert got == [(10, "A", ["G"]), (20, "A", ["G"]), (29, "N", ["NAC"]), (49, "NAC", ["N"])]


def test_hapmap_on_both_strands(spark, tmp_path):
    (tmp_path / "h").write_text(
        "rs# alleles chrom pos strand a b c d e f S1 S2\n"
        "rs1 A/G 1 6 + . . . . . . AG NN\nrs2 C/T 1 9 - . . . . . . CC CT\nrs3 A/C/G 1 9 + . . . . . . AA AC\nrs4 A/T 1 1 + . . . . . . AA AT\nrs9 A/T 1 1 + . . . . . . AA AT\n"
    )
    samples, rows = tables.read_hapmap(spark, str(tmp_path / "h"))
    assert samples == ["S1", "S2"]
    snps = spark.createDataFrame([("1", 5, "rs1", "+", "G", "A/G"), ("1", 8, "rs2", "-", "A", "C/T"), ("1", 8, "rs3", "+", "A", "A/C/G"), ("1", 20, "rs4", "+", "G", "A/T")], "chrom string, start long, name string, strand string, ref string, observed string")
    got = {r.id: (r.pos, r.ref, r.alts, [(s.sample, s.a, s.b) for s in r.samples]) for r in tables.genotypes_of_hapmap(rows, snps, samples).collect()}
    assert got == {"rs1": (6, "G", ["A"], [("S1", 1, 0), ("S2", None, None)]), "rs2": (9, "A", ["G"], [("S1", 1, 1), ("S2", 1, 0)])}


def test_ploidy_and_masked_maps(spark, tmp_path):
    (tmp_path / "s").write_text("a\nb 1\nc 0\n")
    assert sorted(map(tuple, tables.read_sample_list(spark, str(tmp_path / "s")).collect())) == [("a", 2), ("b", 1), ("c", 0)]
    people = spark.createDataFrame([("m", 1), ("f", 2), ("u", None)], "sample string, sex int")
    on = lambda c: {r.sample: r.ploidy for r in tables.sex_ploidy(people, c).collect()}
    assert on("chrX") == {"m": 1, "f": 2, "u": 2} and on("Y") == {"m": 1, "f": 0, "u": 0} and set(on("7").values()) == {2}
    (tmp_path / "map.7").write_text("position COMBINED_rate(cM/Mb) Genetic_Map(cM)\n100 1.0 0.5\n")
    got = tables.read_genetic_maps(spark, str(tmp_path / "map.{CHROM}"), ["7", "8"]).collect()
    assert [tuple(r) for r in got] == [("7", 100, 0.5)]
    (tmp_path / "map.9").write_text("wrong\n100 1.0 0.5\n")
    import pytest

    with pytest.raises(ValueError):
        tables.read_genetic_maps(spark, str(tmp_path / "map.{CHROM}"), ["9"])
