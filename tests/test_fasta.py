"""Reference sequences by byte ranges against the reader that takes a contig at once."""

import random

import pytest
from genoframe.sources.fasta import Contig, fasta_index, read_fasta_ranges, read_index
from genoframe.sources.tables import read_fasta


def written(path, contigs, width, end="\n", last_end=True):
    text = "".join(f">{n} said of {n}{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in contigs.items())
    path.write_bytes((text if last_end else text.removesuffix(end)).encode())


@pytest.mark.parametrize("width, end, last_end", [(60, "\n", True), (7, "\r\n", True), (61, "\n", False)])
def test_equals_the_whole_reader(spark, tmp_path, width, end, last_end):
    rng = random.Random(width)
    contigs = {n: "".join(rng.choice("ACGTNacgt") for _ in range(size)) for n, size in (("one", 5000), ("short", 3), ("exact", 60 * 7 * 61), ("x", 999), ("y", 1000), ("z", 1001))}
    path = tmp_path / "ref.fa"
    written(path, contigs, width, end, last_end)
    want = {(r.chrom, r.chunk): r.seq for r in read_fasta(spark, str(path), chunk=100).collect()}
    for split in (150, 1111, 10**7):
        got = read_fasta_ranges(spark, str(path), chunk=100, split_bytes=split)
        rows = got.collect()
        assert len(rows) == len(want) and {(r.chrom, r.chunk): r.seq for r in rows} == want
        assert split > 5000 or got.rdd.getNumPartitions() > 5  # a contig of many ranges
    assert {c.name: c.length for c in fasta_index(spark, str(path), split_bytes=333)} == {n: len(s) for n, s in contigs.items()}


def test_index_file_and_odd_files(spark, tmp_path):
    path, fai = tmp_path / "ref.fa", tmp_path / "ref.fa.fai"
    written(path, {"a": "ACGTACGTAC", "b": "GG"}, 4)
    fai.write_text("a\t10\t13\t4\t5\nb\t2\t37\t4\t5\n".replace("\t37\t", f"\t{path.read_bytes().index(b'GG')}\t"))
    assert read_index(str(fai))[0] == Contig("a", 10, 13, 4, 5)
    rows = read_fasta_ranges(spark, str(path), chunk=4, index=read_index(str(fai))).collect()
    assert [tuple(r) for r in sorted(rows)] == [("a", 0, "ACGT"), ("a", 1, "ACGT"), ("a", 2, "AC"), ("b", 0, "GG")]
    path.write_text("")
    assert read_fasta_ranges(spark, str(path)).count() == 0
    path.write_text(">empty\n>b\nACGT\n")
    assert [tuple(r) for r in read_fasta_ranges(spark, str(path)).collect()] == [("b", 0, "ACGT")]
    path.write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="different lengths"):
        read_fasta_ranges(spark, str(path), index=[Contig("a", 10, 3, 4, 5)]).count()
