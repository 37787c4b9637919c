"""Phrase collocations: word sequences that occur far more often than their parts let expect.

Each task keeps tries of bounded depth over shards of its texts: every word begins a
path of at most ``DEPTH`` words. A trie is serialised in order of its paths, cut where
the ranges of prefixes begin, and each range merges its slices of all shards. Walking a
merged trie gives a phrase's count and those of its left parts; the suffix link of a
phrase, the phrase without its first word, leads to the counts of its right parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.common import written

DEPTH = 5
#: Words of a shard, of which a task holds one; bytes of text that are cut into words at a time.
SHARD_WORDS, CHUNK_BYTES = 1 << 20, 4 << 20
#: Characters of the corpus to a range of prefixes, the most ranges, and the paths sampled for each. They decide where tries are cut and merged, not what is counted.
RANGE_CHARS, MOST_RANGES, SAMPLES = 6_000_000, 1 << 17, 16

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_SLICE = "lang string, part int, words binary, paths binary, low array<long>, high array<long>"
_NODE = "lang string, m int, phrase string, f long, left array<long>"

Path = tuple[bytes, ...]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with a line feed where a piece ends."""
    return list(filter(None, text.translate(_LETTERS).replace(b"\n", b" \n ").split(b" ")))


# --- tries ---------------------------------------------------------------------
#
# A trie is held as its sorted paths: a matrix with a row for each different path, whose
# columns are word numbers in order of the words (0 past a path's end), and their counts.


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths sorted, equal ones as one with the sum of their counts (1 each if None)."""
    padded = [*columns, *[np.zeros_like(columns[0])] * (DEPTH % 2)]
    keys = [(a.astype("uint64") << np.uint64(32)) | b.astype("uint64") for a, b in zip(padded[::2], padded[1::2])]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(order))
    total = ends - at if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return [c[order[at]] for c in columns], total.astype("int64")


class Shard:
    """The texts of one language that a task has read since its last slices."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {b"\n": 0}
        self.runs: list[tuple[np.ndarray, int]] = []  # word numbers, and how many of them begin a path
        self.size = 0

    def add(self, words: list[bytes], starts: int) -> None:
        for w in words:
            if w not in self.numbers:
                self.numbers[w] = len(self.numbers)
        self.runs.append((np.fromiter(map(self.numbers.__getitem__, words), "int32", len(words)), starts))
        self.size += len(words)

    def trie(self) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """The sorted vocabulary (a word's number is its place from 1), paths and counts."""
        vocabulary = sorted(w for w in self.numbers if w != b"\n")
        rank = np.zeros(len(self.numbers), "int32")
        rank[[self.numbers[w] for w in vocabulary]] = np.arange(1, len(vocabulary) + 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        for run, starts in self.runs:
            run = np.append(rank[run], np.zeros(DEPTH, "int32"))
            here, live = run[:starts], np.flatnonzero(run[:starts])
            for d in range(DEPTH):
                here = run[live + d] if d == 0 else np.where(here > 0, run[live + d], 0)
                columns[d].append(here)
        return vocabulary, *_distinct([np.concatenate(c) for c in columns], None)


def _places(vocabulary: list[bytes], columns: list[np.ndarray], counts: np.ndarray, path: Path) -> tuple[int, list[int]]:
    """Where ``path`` begins among the sorted paths, and the counts of its proper beginnings, ``DEPTH`` - 1 of them."""
    total, lo, hi = [0] * (DEPTH - 1), 0, len(counts)
    for d, word in enumerate(path):
        k = bisect_left(vocabulary, word)
        found = k < len(vocabulary) and vocabulary[k] == word
        column = columns[d][lo:hi]
        if not found:  # paths with a later word here are past it
            return lo + int(np.searchsorted(column, k + 1)), total
        lo, hi = lo + int(np.searchsorted(column, k + 1)), lo + int(np.searchsorted(column, k + 1, "right"))
        if d < min(DEPTH, len(path)) - 1:
            total[d] = int(counts[lo:hi].sum())
        if lo == hi:
            return lo, total
    return lo, total


def serialised(columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The word numbers that occur, and the sorted paths as bytes: of each what it does not share with the one before."""
    shared = np.zeros(len(counts), "uint8")
    same = np.ones(max(0, len(counts) - 1), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
        shared[1:] += same
    used, own = np.unique(np.concatenate([c[shared <= d] for d, c in enumerate(columns)]), return_inverse=True)
    kind = lambda top: "uint8" if top < 256 else "uint16" if top < 65536 else "uint32"
    kinds = [kind(len(used)), kind(int(counts.max())) if counts.max() < 1 << 32 else "uint64"]
    head = np.array([len(counts), len(own), *[np.dtype(k).itemsize for k in kinds]], "int64")
    raw = b"".join([head.tobytes(), shared.tobytes(), own.astype(kinds[0]).tobytes(), counts.astype(kinds[1]).tobytes()])
    return used, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def restored(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of places among the slice's own words, and counts."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, own, *sizes = np.frombuffer(raw, "int64", 4).tolist()
    shared = np.frombuffer(raw, "uint8", n, 32)
    flat = np.frombuffer(raw, f"uint{8 * sizes[0]}", own, 32 + n)
    counts = np.frombuffer(raw, f"uint{8 * sizes[1]}", n, 32 + n + own * sizes[0])
    columns, begin = [], 0
    for d in range(DEPTH):  # by column: the new words, each carried on to the paths that share it
        new = shared <= d
        n_new = int(new.sum())
        columns.append(flat[begin : begin + n_new][np.cumsum(new) - 1])
        begin += n_new
    return columns, counts.astype("int64")


def _slices(lang: str, shard: Shard, cuts: list[Path]) -> Iterator[tuple]:
    """The shard's trie cut at ``cuts``; a slice knows the counts of the nodes above its two ends."""
    vocabulary, columns, counts = shard.trie()
    placed = [_places(vocabulary, columns, counts, c) for c in cuts]
    ends, above = [0, *[p[0] for p in placed], len(counts)], [[], *[p[1] for p in placed], []]
    for part, (a, b, low, high) in enumerate(zip(ends, ends[1:], above, above[1:])):
        if a < b:
            used, paths = serialised([c[a:b] for c in columns], counts[a:b])
            yield lang, part, b"\n".join([b"" if k == 0 else vocabulary[k - 1] for k in used.tolist()]), paths, low, high
        elif any(low) or any(high):
            yield lang, part, None, None, low, high


def shard_tries(cuts: dict[str, list[Path]], shard_words: int):
    """Texts (lang, text) to slices of tries, a shard after the other."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["lang", "part", "words", "paths", "low", "high"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for lang, shard in shards.items():
                for row in _slices(lang, shard, cuts.get(lang, [])):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size > CHUNK_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)
            shards.clear()

        for lang, text in _chunks(batches):
            words = words_of(text)
            for at in range(0, len(words), shard_words):  # one text may be longer than a shard: paths go on into the next words
                piece = words[at : at + shard_words + DEPTH - 1]
                if held and held + len(piece) > shard_words:
                    yield from flushed()
                    held = 0
                shards.setdefault(lang, Shard()).add(piece, min(shard_words, len(words) - at))
                held += len(piece)
        yield from flushed()

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, line feeds between them, in about ``CHUNK_BYTES`` at a time."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        langs, texts = b.column(0), b.column(1).cast(pa.binary())
        for k in range(b.num_rows):
            text = texts[k].as_py()
            waiting.setdefault(langs[k].as_py(), []).append(text)
            size += len(text)
            if size > CHUNK_BYTES:
                yield from ((lang, b"\n".join(t)) for lang, t in waiting.items())
                waiting, size = {}, 0
    yield from ((lang, b"\n".join(t)) for lang, t in waiting.items())


def merged(cuts: dict[str, list[Path]], least: int):
    """Slices of one range of a language, of all shards, to the nodes that occur ``least`` times.

    One row more, of no words, has the number of words that begin a path in the range. A
    node that a cut runs through is given by the range in which its subtree begins; its
    count, and that of any node above a cut, is the sum of what the shards know of it.
    """

    def merge(slices: pa.Table) -> pa.Table:
        lang, part = slices["lang"][0].as_py(), slices["part"][0].as_py()
        own = cuts.get(lang, [])
        low, high = (own[part - 1] if part else ()), (own[part] if part < len(own) else ())
        sums = lambda name: np.sum([x + [0] * (DEPTH - 1 - len(x)) for x in slices[name].to_pylist()], axis=0, dtype="int64")
        low_f, high_f = sums("low").tolist(), sums("high").tolist()
        nodes: list[tuple] = []
        beginnings = [low[:d] for d in range(1, len(low))]
        for d in range(1, len(high)):
            if high[:d] not in beginnings and high_f[d - 1] >= least:
                nodes.append((d, high[:d], high_f[d - 1], high_f[: d - 1]))
        numbers: dict[bytes, int] = {b"": 0}
        columns, counts = [[] for _ in range(DEPTH)], []
        for words, paths in zip(slices["words"], slices["paths"]):
            if paths.is_valid:
                named = words.as_py().split(b"\n")
                for w in named:
                    if w not in numbers:
                        numbers[w] = len(numbers)
                own_number = np.fromiter(map(numbers.__getitem__, named), "int32", len(named))
                cols, n = restored(paths.as_py())
                for d, c in enumerate(cols):
                    columns[d].append(own_number[c])
                counts.append(n)
        total = 0
        if counts:
            vocabulary = sorted(numbers)  # the empty word, past a path's end, is first
            rank = np.empty(len(numbers), "int32")
            rank[[numbers[w] for w in vocabulary]] = np.arange(len(vocabulary))
            tops, n = _distinct([rank[np.concatenate(c)] for c in columns], np.concatenate(counts))
            total = int(n.sum())
            nodes += _walk(vocabulary, tops, n, low, low_f, high, high_f, least)
        nodes.append((0, None, total, []))
        phrases = [None if p is None else b" ".join(p).decode() for _, p, _, _ in nodes]
        arrays = [pa.array([lang] * len(nodes), pa.string()), pa.array([x[0] for x in nodes], pa.int32()), pa.array(phrases, pa.string())]
        arrays += [pa.array([x[2] for x in nodes], pa.int64()), pa.array([x[3] for x in nodes], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, names=["lang", "m", "phrase", "f", "left"])

    return merge


def _walk(vocabulary: list[bytes], columns: list[np.ndarray], counts: np.ndarray, low: Path, low_f: list[int], high: Path, high_f: list[int], least: int) -> Iterator[tuple]:
    """(words, phrase, count, counts of its beginnings) of the frequent nodes of a merged trie that the range itself gives."""
    new, starts, totals = np.zeros(len(counts), bool), [], []
    new[0] = True
    for d, column in enumerate(columns):
        new[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(new)
        f, known = np.add.reduceat(counts, begin), column[begin] > 0
        path = lambda k: tuple(vocabulary[c[begin[k]]] for c in columns[: d + 1])  # noqa: B023, E731
        given = known & (f >= least)
        for k, cut, cut_f in ((0, low, low_f), (-1, high, high_f)):
            if len(cut) > d + 1 and path(k) == cut[: d + 1]:  # its count is that of all ranges, and it is given elsewhere
                f[k], given[k] = cut_f[d], False
        starts.append(begin)
        totals.append(f)
        at = begin[given]
        left = np.stack([totals[e][np.searchsorted(starts[e], at, "right") - 1] for e in range(d)], 1) if d else np.zeros((len(at), 0), "int64")
        names = [[vocabulary[w] for w in c[at].tolist()] for c in columns[: d + 1]]
        yield from zip([d + 1] * len(at), zip(*names), f[given].tolist(), left.tolist())


# --- ranges --------------------------------------------------------------------


def _sampled(step: int):
    """A path from every ``step`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = step // 2
        for b in batches:
            langs, paths = [], []
            for lang, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                text = text.as_py()
                while wait < len(text):
                    found = words_of(text[wait : wait + 400])[1:]
                    path = found[: found.index(b"\n") if b"\n" in found[:DEPTH] else DEPTH]
                    if path:
                        langs.append(lang.as_py())
                        paths.append(b" ".join(path))
                    wait += step
                wait -= len(text)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(paths, pa.binary())], names=["lang", "path"])

    return run


def prefix_cuts(rows: DataFrame, range_chars: int = RANGE_CHARS) -> dict[str, list[Path]]:
    """For each language the paths at which ranges begin: at most ``MOST_RANGES`` in all, from a bounded sample of paths."""
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_RANGES, chars // range_chars + 1)
    sample = rows.mapInArrow(_sampled(max(1, chars // (n * SAMPLES))), "lang string, path binary").collect()  # SAMPLES for each range
    by: dict[str, list[Path]] = {}
    for lang, path in sample:
        by.setdefault(lang, []).append(tuple(bytes(path).split(b" ")))
    return {lang: sorted(set(sorted(paths)[SAMPLES::SAMPLES])) for lang, paths in by.items()}


# --- scores --------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, least: int = 100, *, shard_words: int = SHARD_WORDS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(lang, m, phrase, f, left): phrases of ``m`` = 1 to ``DEPTH`` words that occur ``least`` times in a language, with the counts of their beginnings.

    Rows with ``m`` 0 have in ``f`` words of the language; their sum is the number of all.
    """
    rows = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    cuts = prefix_cuts(rows, range_chars)
    slices = rows.mapInArrow(shard_tries(cuts, shard_words), _SLICE)
    return slices.groupBy("lang", "part").applyInArrow(merged(cuts, least), _NODE)


def lift(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(docs: DataFrame, *, least: int = 100, most: int = 2000, salts: int = 8, made: list[str] | None = None, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``most`` best phrases.

    A phrase has 2 to ``DEPTH`` words of one piece and occurs at least ``least`` times; its
    score is the lowest of its cuts in two, the earliest of equals. Phrases inside a
    longer one that occurs as often are left out: it is enough to look one word further,
    since every phrase between them occurs as often too. Null texts are empty, a null
    lang is ``und``; repeated rows count as often as they come; no text gives no row.
    Paths of the written tables are added to ``made``.
    """
    every = written(frequent_phrases(docs, least, **sizes), "phrases", made)
    n = every.filter("m = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = every.filter("m > 1")
    last = lambda k: F.substring_index("phrase", " ", -k)
    links = phrases.select("lang", "phrase", F.col("f").alias("a"), "m", F.posexplode("left").alias("_at", "l"))
    links = links.withColumns({"k": F.col("_at") + 1, "suffix": F.expr("substring_index(phrase, ' ', _at + 1 - m)")})
    right = every.filter("m > 0").select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("r"))
    parts = links.join(right, ["lang", "suffix"]).select("lang", "phrase", "a", F.struct("k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("over"))
    inside = F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)")))
    longer = phrases.filter("m > 2").select("lang", inside.alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("struct<k:int,l:bigint,r:bigint>").alias("cut"), F.col("f").alias("over"))
    whole = parts.unionByName(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.collect_list("cut").alias("cuts"), F.max("over").alias("over"))
    whole = whole.filter(F.col("over").isNull() | (F.col("over") < F.col("a"))).join(n, "lang")
    scored = F.array_min(F.transform("cuts", lambda c: F.struct(lift(F.col("a"), F.col("n"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    rows = whole.select("lang", "phrase", "a", "n", scored.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each share of a language first, so that a language is not ranked in one task.
    share = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
