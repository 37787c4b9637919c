"""Block-gzipped files, split at blocks, and the binary variant format inside them.

Block gzip is a row of small gzip members that each name their own length, so a reader
can begin anywhere: it looks for the next member and goes on from there. Files are opened
by Arrow's file systems, which driver and executors must both reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Compressed bytes to a task, and bytes read at a time.
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Fixed values of the format: how a member begins, its largest size, the empty member at the end.
_BEGIN, _MOST = b"\x1f\x8b\x08\x04", 1 << 16
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_ROWS, _BATCH_BYTES = 20_000, 8 << 20


def block_gzip(data: bytes, size: int = 0xFF00) -> bytes:
    """``data`` as block gzip; what several calls return may be put one after the other."""
    out = []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out.append(struct.pack("<4sIBBHBBHH", _BEGIN, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + _END


def _member_size(buf: bytes, at: int) -> int:
    """The length of the member that begins at ``at``; 0 if none does."""
    if buf[at : at + 4] != _BEGIN or len(buf) < at + 12:
        return 0
    extra = int.from_bytes(buf[at + 10 : at + 12], "little")
    k, end = at + 12, at + 12 + extra
    while k + 4 <= min(end, len(buf)):
        length = int.from_bytes(buf[k + 2 : k + 4], "little")
        if buf[k : k + 2] == b"BC" and length == 2 and k + 6 <= len(buf):
            return int.from_bytes(buf[k + 4 : k + 6], "little") + 1
        k += 4 + length
    return 0


class _Members:
    def __init__(self, path: str) -> None:
        fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()

    def first(self, begin: int) -> int | None:
        """The first member that begins at or after ``begin``: one that others follow, or the file's end."""
        buf = self.file.read_at(min(4 * _MOST, self.size - begin), begin) if begin < self.size else b""
        at = buf.find(_BEGIN)
        while at >= 0:
            k, seen = at, 0
            while seen < 3 and (n := _member_size(buf, k)):
                k, seen = k + n, seen + 1
            if seen and (k + begin >= self.size or seen == 3 or k >= len(buf) - 18):
                return begin + at
            at = buf.find(_BEGIN, at + 1)
        return None

    def read(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(offset, bytes) of each member from ``at`` on."""
        buf, base = b"", at
        while at < self.size:
            if len(buf) - (at - base) < _MOST and base + len(buf) < self.size:
                buf, base = buf[at - base :], at
                buf += self.file.read_at(min(READ_BYTES, self.size - base - len(buf)), base + len(buf))
            k = at - base
            n = _member_size(buf, k)
            if not n or k + n > len(buf):
                raise ValueError(f"no block at {at}")
            extra = int.from_bytes(buf[k + 10 : k + 12], "little")
            yield at, zlib.decompress(buf[k + 12 + extra : k + n - 8], -15)
            at += n


def _lines(path: str, begin: int, end: int) -> Iterator[list[bytes]]:
    """Lines that begin behind the first line end of the members from ``begin``, up to the one that begins where those before ``end`` stop."""
    members = _Members(path)
    start = 0 if begin == 0 else members.first(begin)
    if start is None or start >= end:
        return
    rest, skipping = b"", begin > 0
    for offset, data in members.read(start):
        if offset >= end:
            if skipping:
                return
            rest += data
            if b"\n" in data:
                yield [rest[: rest.index(b"\n")]]
                return
            continue
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        if skipping and lines:
            lines, skipping = lines[1:], False
        yield lines
    if rest and not skipping:
        yield [rest]


# --- binary records --------------------------------------------------------------

_INTS = {1: ("i1", -128), 2: ("<i2", -32768), 3: ("<i4", -(2**31))}
_MISSING_FLOAT, _END_FLOAT = 0x7F800001, 0x7F800002


class _Typed:
    """Typed values of a record: a byte with the length and the type, then the values."""

    def __init__(self, buf: bytes) -> None:
        self.buf, self.at = buf, 0

    def head(self) -> tuple[int, int]:
        n, kind = self.buf[self.at] >> 4, self.buf[self.at] & 15
        self.at += 1
        return (int(self.value()[0]) if n == 15 else n), kind

    def array(self, n: int, kind: int) -> np.ndarray:
        dtype = {5: "<u4", 7: "S1"}.get(kind) or _INTS[kind][0]
        out = np.frombuffer(self.buf, dtype, n, self.at)
        self.at += out.nbytes
        return out

    def value(self) -> list | str:
        n, kind = self.head()
        if kind == 0:
            return []
        return shown(self.array(n, kind), kind)


def float_text(bits: int) -> str:
    return f"{np.array([bits], '<u4').view('<f4')[0]:.6g}"


def shown(values: np.ndarray, kind: int) -> list | str:
    """Values up to the mark that ends a shorter vector; missing ones are None, floats as text."""
    if kind == 7:
        return values.tobytes().rstrip(b"\0").decode()
    if kind == 5:
        ends = np.flatnonzero(values == _END_FLOAT)
        return [None if v == _MISSING_FLOAT else float_text(v) for v in values[: ends[0] if len(ends) else None].tolist()]
    missing = _INTS[kind][1]
    ends = np.flatnonzero(values == missing + 1)
    return [None if v == missing else v for v in values[: ends[0] if len(ends) else None].tolist()]


def _joined(value: list | str) -> str:
    return (value or ".") if isinstance(value, str) else ",".join("." if v is None else str(v) for v in value) or "."


def genotype_text(codes: list) -> str:
    """Packed alleles (twice the number plus 2, plus 1 if phased; 0 or 1 is missing) as ``0/1``, ``0|1``."""
    out = "".join(("|" if k and c & 1 else "/" if k else "") + ("." if c < 2 else str((c >> 1) - 1)) for k, c in enumerate(codes))
    return out or "."


class Dictionary:
    """What a binary header's numbers stand for: contigs, samples, and the tags of filters, INFO and FORMAT in order of first mention."""

    def __init__(self, text: str) -> None:
        self.lines = text.rstrip("\0\n").split("\n")
        self.contigs: dict[int, str] = {}
        self.tags: dict[int, str] = {0: "PASS"}
        self.flags: set[str] = set()
        known, n_contigs = {"PASS"}, 0
        for line in self.lines:
            what, _, rest = line.removeprefix("##").partition("=<")
            if what not in ("contig", "FILTER", "INFO", "FORMAT"):
                continue
            fields = dict(f.partition("=")[::2] for f in rest.rstrip(">").split(",") if "=" in f)
            name = fields["ID"]
            if what == "contig":
                self.contigs[int(fields.get("IDX", n_contigs))] = name
                n_contigs += 1
                continue
            if fields.get("Type") == "Flag":
                self.flags.add(name)
            if name not in known or "IDX" in fields:
                self.tags[int(fields.get("IDX", len(self.tags)))] = name
                known.add(name)


def record_text(names: Dictionary, shared: bytes, indiv: bytes) -> str:
    """A binary record as a tab-separated line."""
    chrom, pos, _, qual, alleles_info, samples_formats = struct.unpack_from("<iiiIII", shared)
    t = _Typed(shared)
    t.at = 24
    n_alleles, n_info, n_samples, n_formats = alleles_info >> 16, alleles_info & 0xFFFF, samples_formats & 0xFFFFFF, samples_formats >> 24
    name = t.value() or "."
    alleles = [t.value() for _ in range(n_alleles)]
    filters = t.value()
    info = []
    for _ in range(n_info):
        tag, value = names.tags[t.value()[0]], t.value()
        info.append(tag if tag in names.flags else f"{tag}={_joined(value)}")
    cells = [names.contigs[chrom], str(pos + 1), name, alleles[0], ",".join(alleles[1:]) or ".", "." if qual == _MISSING_FLOAT else float_text(qual)]
    cells += [";".join(names.tags[f] for f in filters) or ".", ";".join(info) or "."]
    if n_samples:
        t, tags, columns = _Typed(indiv), [], []
        for _ in range(n_formats):
            tags.append(names.tags[t.value()[0]])
            n, kind = t.head()
            each = t.array(n * n_samples, kind).reshape(n_samples, n) if kind else np.empty((n_samples, 0), "i1")
            values = [shown(v, kind) if kind else [] for v in each]
            columns.append([genotype_text(v) for v in values] if tags[-1] == "GT" else [_joined(v) for v in values])
        cells += [":".join(tags), *[":".join(c) for c in zip(*columns)]] if n_formats else ["."] * (n_samples + 1)
    return "\t".join(cells)


def _binary_lines(path: str) -> Iterator[list[bytes]]:
    """Header lines, then records, as text. Records do not say where they begin, so a file is read from its start."""
    data, need = bytearray(), 9
    names, at = None, 0
    for _, part in _Members(path).read(0):
        data += part
        out: list[bytes] = []
        while len(data) - at >= need:
            if names is None:
                if bytes(data[:3]) != b"BCF":
                    raise ValueError(f"{path} is no binary variant file")
                length = int.from_bytes(data[5:9], "little")
                need = 9 + length
                if len(data) >= need:
                    names, at, need = Dictionary(data[9 : 9 + length].decode()), need, 8
                    out += [x.encode() for x in names.lines]
                continue
            n_shared, n_indiv = struct.unpack_from("<II", data, at)
            need = 8 + n_shared + n_indiv
            if len(data) - at >= need:
                shared = bytes(data[at + 8 : at + 8 + n_shared])
                out.append(record_text(names, shared, bytes(data[at + 8 + n_shared : at + need])).encode())
                at, need = at + need, 8
        del data[:at]
        at = 0
        yield out


# --- the data source -------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int
    binary: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[_Range]:
        members = _Members(self.path)
        first = next(members.read(0), (0, b""))[1]
        if first[:3] == b"BCF":
            return [_Range(self.path, 0, members.size, True)]
        return [_Range(self.path, at, min(at + self.split, members.size), False) for at in range(0, max(1, members.size), self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], names=["value"])
        for lines in _binary_lines(partition.path) if partition.binary else _lines(partition.path, partition.begin, partition.end):
            held += lines
            size += sum(map(len, lines))
            if len(held) >= _ROWS or size >= _BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        yield batch(held)


class BlockGzip(DataSource):
    """Lines of a block-gzipped text file, or of a binary one as text. Options: ``path``, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_block_lines(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value): the lines of block-gzipped files, in ranges of ``split_bytes`` to a task; binary files are a task each."""
    spark.dataSource.register(BlockGzip)
    frames = [spark.read.format("block_gzip").option("splitBytes", split_bytes).load(p) for p in ([path] if isinstance(path, str) else path)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
