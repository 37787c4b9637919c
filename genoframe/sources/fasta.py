"""Reference sequences by byte ranges: an index of where each contig's lines are, then chunks from many tasks.

A contig's lines are of one length but for the last, so any base's place in the file is
known from the index. Both steps are Python data sources over Arrow's file systems,
which driver and executors must both reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file to a task, and to a read.
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20


def _opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name)


@dataclass
class Contig:
    """``start``: place of the first base; ``bases`` and ``width``: of a line without and with its end; ``length``: of the contig."""

    name: str
    length: int
    start: int
    bases: int
    width: int


@dataclass
class _Span(InputPartition):
    begin: int
    end: int


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options["splitBytes"])

    def partitions(self) -> list[_Span]:
        size = _opened(self.path).size()
        return [_Span(at, min(at + self.split, size)) for at in range(0, max(size, 1), self.split)]

    def read(self, p: _Span) -> Iterator[tuple]:
        """A row for each heading that begins in the range: its place, and where and how wide its first line of bases is."""
        file = _opened(self.path)
        size, at = file.size(), p.begin
        before = file.read_at(1, at - 1) if at else b"\n"
        while at < p.end:
            part = file.read_at(min(READ_BYTES, p.end - at), at)
            k = part.find(b">")
            while k >= 0:
                if (part[k - 1 : k] if k else before) == b"\n":
                    yield (at + k, *_heading(file, at + k, size))
                k = part.find(b">", k + 1)
            before, at = part[-1:], at + len(part)


def _heading(file, at: int, size: int) -> tuple[str, int, int, int]:
    head = b""
    while b"\n" not in head and at + len(head) < size:
        head += file.read_at(min(4096, size - at - len(head)), at + len(head))
    line, _, rest = head.partition(b"\n")
    start = at + len(line) + 1
    while b"\n" not in rest and start + len(rest) < size:
        rest += file.read_at(min(65536, size - start - len(rest)), start + len(rest))
    first, found, _ = rest.partition(b"\n")
    if first[:1] == b">":
        first, found = b"", b""
    return (line[1:].split() or [b""])[0].decode(), start, len(first.rstrip(b"\r")), len(first) + len(found)


class FastaIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_index"

    def schema(self) -> str:
        return "at long, name string, start long, bases long, width long"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options)


def fasta_index(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> list[Contig]:
    """The contigs in order of the file, found by ranges; a row of each comes to the driver. Contigs without bases have length 0."""
    spark.dataSource.register(FastaIndex)
    found = sorted(spark.read.format("fasta_index").option("splitBytes", split_bytes).load(path).collect())
    file = _opened(path)
    ends = [r.at for r in found[1:]] + [file.size()]
    out = []
    for r, end in zip(found, ends):
        tail = file.read_at(min(256, max(0, end - r.start)), max(r.start, end - 256)) if r.width else b""
        end -= len(tail) - len(tail.rstrip(b"\r\n"))
        lines, over = divmod(max(0, end - r.start), r.width) if r.width else (0, 0)
        out.append(Contig(r.name, lines * r.bases + min(over, r.bases), r.start, r.bases, r.width))
    return out


def read_index(path: str) -> list[Contig]:
    """An index file: name, length, place of the first base, bases and bytes of a line."""
    with _opened(path) as file:
        rows = [x.split("\t") for x in file.read().decode().splitlines() if x.strip()]
    return [Contig(r[0], *map(int, r[1:5])) for r in rows]


@dataclass
class _Chunks(InputPartition):
    parts: list[tuple[Contig, int, int]]  # a contig and its chunks from, to


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk, self.split = options["path"], int(options["chunk"]), int(options["splitBytes"])
        numbers = [options[f"contig{k}"].split("\t") for k in range(int(options["contigs"]))]
        self.contigs = [Contig(n, *map(int, rest)) for n, *rest in numbers]

    def partitions(self) -> list[_Chunks]:
        """Ranges of about ``splitBytes``: a long contig is of many, many short ones are of one."""
        out, room, step = [_Chunks([])], self.split, max(1, self.split // self.chunk)
        for c in self.contigs:
            k, last = 0, -(-c.length // self.chunk)
            while k < last:
                if room < self.chunk:
                    out.append(_Chunks([]))
                    room = self.split
                n = min(last - k, max(1, room // self.chunk), step)
                out[-1].parts.append((c, k, k + n))
                k, room = k + n, room - n * self.chunk
        return out

    def read(self, p: _Chunks) -> Iterator[pa.RecordBatch]:
        file = _opened(self.path)
        for c, first, last in p.parts:
            per = max(1, READ_BYTES // self.chunk)
            for k in range(first, last, per):
                to = min(k + per, last)
                seq = self._bases(file, c, k * self.chunk, min(to * self.chunk, c.length)).decode().upper()
                cut = [seq[i : i + self.chunk] for i in range(0, len(seq), self.chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([c.name] * len(cut)), pa.array(range(k, to), pa.int32()), pa.array(cut)], names=["chrom", "chunk", "seq"])

    @staticmethod
    def _bases(file, c: Contig, begin: int, end: int) -> bytes:
        at = lambda base: c.start + base // c.bases * c.width + base % c.bases
        lines = file.read_at(at(end - 1) + 1 - at(begin), at(begin)).replace(b"\r", b"").split(b"\n")
        seq = b"".join(lines)
        even = len(lines) == 1 or (begin % c.bases + len(lines[0]) == c.bases and all(len(x) == c.bases for x in lines[1:-1]))
        if not even or len(seq) != end - begin or b">" in seq:
            raise ValueError(f"lines of {c.name} are of different lengths")
        return seq


class FastaChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return "chrom string, chunk int, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


def read_fasta_ranges(spark: SparkSession, path: str, *, chunk: int = 1000, index: list[Contig] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(chrom, chunk, seq) like :func:`genoframe.sources.tables.read_fasta`, of an uncompressed file, from tasks of ``split_bytes`` each.

    ``index`` may come from :func:`read_index`; else it is made. A contig whose lines are
    not of one length but for the last is an error.
    """
    contigs = fasta_index(spark, path, split_bytes=split_bytes) if index is None else index
    spark.dataSource.register(FastaChunks)
    options = {f"contig{k}": f"{c.name}\t{c.length}\t{c.start}\t{c.bases}\t{c.width}" for k, c in enumerate(contigs)}
    return spark.read.format("fasta_chunks").options(chunk=chunk, splitBytes=split_bytes, contigs=len(contigs), **options).load(path)
