"""Block-gzipped and binary files against the plain text."""

import random
import struct

import pytest
from genoframe.sources import blocks
from genoframe.sources.vcf import read_vcf

HEAD = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
##contig=<ID=1,length=1000>
##contig=<ID=X>
##FILTER=<ID=q10,Description="low, very low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##INFO=<ID=NOTE,Number=1,Type=String,Description="note">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="l">
##FORMAT=<ID=FT,Number=1,Type=String,Description="t">
"""
TAGS = ["PASS", "q10", "DP", "AF", "DB", "NOTE", "GT", "GL", "FT"]
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"


def drawn(n):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        alts = rng.choice([[], ["C"], ["G", "<DEL>"], ["AC" * rng.choice([1, 20])]])
        g = (len(alts) + 1) * (len(alts) + 2) // 2
        number = lambda: rng.choice([None, 0.5, 1.25, 100000, 1e-06, 3])
        info = {"DP": [rng.choice([None, 0, 5, 300, 70000])], "AF": [number() for _ in alts] or [None], "DB": True, "NOTE": rng.choice(["x", "long" * 6])}
        info = {t: v for t, v in info.items() if rng.random() < 0.7}
        sample = lambda: {
            "GT": [rng.choice([None, *range(len(alts) + 1)]) for _ in range(rng.choice([1, 2, 2]))], "phased": rng.random() < 0.5,
            "DP": [rng.choice([None, 3, 200])], "GL": [number() for _ in range(rng.choice([1, g]))], "FT": rng.choice(["ok", "", "longer"]),
        }
        rows.append((rng.choice([0, 1]), k + 1, rng.choice([None, f"rs{k}"]), "A", alts, number(), rng.choice([[], [0], [1]]), info, [sample(), sample()]))
    return rows


def text(v):
    return "." if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def line(r):
    contig, pos, name, ref, alts, qual, filters, info, samples = r
    shown = [t if v is True else f"{t}={v if isinstance(v, str) else ','.join(map(text, v))}" for t, v in info.items()]
    gt = lambda s: ("|" if s["phased"] else "/").join(map(text, s["GT"]))
    cells = [["1", "X"][contig], str(pos), name or ".", ref, ",".join(alts) or ".", text(qual), ";".join(TAGS[f] for f in filters) or ".", ";".join(shown) or ".", "GT:DP:GL:FT"]
    return "\t".join(cells + [":".join([gt(s), text(s["DP"][0]), ",".join(map(text, s["GL"])), s["FT"] or "."]) for s in samples])


def ints(values, width=None):
    known = [v for v in values if v is not None]
    kind, code, low = next((k, c, m) for k, c, m in ((1, "b", -128), (2, "h", -32768), (3, "i", -(2**31))) if all(m + 8 <= v <= -m - 1 for v in known))
    return kind, lambda vs, w: b"".join(struct.pack("<" + code, low if v is None else v) for v in vs) + struct.pack("<" + code, low + 1) * (w - len(vs))


def floats(vs, w):
    bits = [0x7F800001 if v is None else struct.unpack("<I", struct.pack("<f", v))[0] for v in vs] + [0x7F800002] * (w - len(vs))
    return struct.pack(f"<{w}I", *bits)


def head(n, kind):
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + bytes([1 << 4 | 2]) + struct.pack("<h", n)


def typed(value):
    if isinstance(value, str):
        return head(len(value.encode()), 7) + value.encode()
    if value is True or value == []:
        return b"\0"
    if any(isinstance(v, float) for v in value):
        return head(len(value), 5) + floats(value, len(value))
    kind, pack = ints(value)
    return head(len(value), kind) + pack(value, len(value))


def record(r):
    contig, pos, name, ref, alts, qual, filters, info, samples = r
    shared = struct.pack("<iii", contig, pos - 1, len(ref)) + floats([qual], 1) + struct.pack("<II", (len(alts) + 1) << 16 | len(info), 4 << 24 | 2)
    shared += (typed(name) if name else b"\x07") + b"".join(typed(a) for a in [ref, *alts]) + typed(filters)
    for t, v in info.items():
        v = [None if x is None else float(x) for x in v] if t == "AF" and any(x is not None for x in v) else v
        shared += typed([TAGS.index(t)]) + typed(v)
    gts = [[((a + 1 if a is not None else 0) << 1) | (1 if k and s["phased"] else 0) for k, a in enumerate(s["GT"])] for s in samples]
    indiv = b""
    for t, per in (("GT", gts), ("DP", [s["DP"] for s in samples])):
        w = max(map(len, per))
        kind, pack = ints([v for p in per for v in p])
        indiv += typed([TAGS.index(t)]) + head(w, kind) + b"".join(pack(p, w) for p in per)
    w = max(len(s["GL"]) for s in samples)
    indiv += typed([TAGS.index("GL")]) + head(w, 5) + b"".join(floats(s["GL"], w) for s in samples)
    w = max(1, *(len(s["FT"]) for s in samples))
    indiv += typed([TAGS.index("FT")]) + head(w, 7) + b"".join(s["FT"].encode().ljust(w, b"\0") for s in samples)
    return struct.pack("<II", len(shared), len(indiv)) + shared + indiv


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("blocks"), drawn(700)
    plain = HEAD + COLUMNS + "\n" + "".join(line(r) + "\n" for r in rows)
    (folder / "plain.vcf").write_text(plain)
    (folder / "small.vcf.gz").write_bytes(blocks.block_gzip(plain.encode(), 997))  # records cross blocks
    (folder / "lines.vcf.gz").write_bytes(b"".join(blocks.block_gzip(x.encode() + b"\n") for x in plain.splitlines()))  # blocks end where lines do, empty ones between
    dictionary = (HEAD + COLUMNS + "\n\0").encode()
    binary = b"BCF\2\2" + struct.pack("<I", len(dictionary)) + dictionary + b"".join(map(record, rows))
    (folder / "all.bcf").write_bytes(blocks.block_gzip(binary, 1500))
    return folder


def rows_of(found):
    return sorted(str(r.asDict(recursive=True)) for r in found.drop("rec").collect())


def test_split_text_equals_the_plain_file(spark, files):
    header, want = read_vcf(spark, str(files / "plain.vcf"))
    for name in ("small.vcf.gz", "lines.vcf.gz"):
        for split in (300, 1000, 4099, 1 << 20):
            own, got = read_vcf(spark, str(files / name), blocks=True, split_bytes=split)
            assert own == header and rows_of(got) == rows_of(want)
            assert got.rdd.getNumPartitions() == -(-(files / name).stat().st_size // split)
    in_order = [r.pos for r in read_vcf(spark, str(files / "small.vcf.gz"), blocks=True, split_bytes=2000)[1].orderBy("rec").collect()]
    assert in_order == list(range(1, 701))


def test_two_files_and_no_lines(spark, files, tmp_path):
    both = [str(files / "small.vcf.gz"), str(files / "lines.vcf.gz")]
    assert read_vcf(spark, both, blocks=True)[1].count() == 1400
    (tmp_path / "empty.gz").write_bytes(blocks.block_gzip(b""))
    assert blocks.read_block_lines(spark, str(tmp_path / "empty.gz")).count() == 0
    (tmp_path / "one.gz").write_bytes(blocks.block_gzip(b"no line end " * 9000, 50))
    assert [len(r.value) for r in blocks.read_block_lines(spark, str(tmp_path / "one.gz"), 800).collect()] == [108000]
    (tmp_path / "not.gz").write_bytes(b"plain text")
    with pytest.raises(Exception, match="no block"):
        blocks.read_block_lines(spark, str(tmp_path / "not.gz")).count()


def test_binary_equals_the_text(spark, files):
    header, want = read_vcf(spark, str(files / "plain.vcf"))
    own, got = read_vcf(spark, str(files / "all.bcf"), blocks=True)
    assert own == header and rows_of(got) == rows_of(want)
