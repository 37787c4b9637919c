"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made in the executors, and equal ones are grouped first, so
that exact copies never meet each other. Distinct fingerprints are dealt out by
keys: the 64 bits are cut into ``b`` blocks and every choice of ``b - 4`` blocks is
a key, so that two fingerprints with at most 4 differing bits share a key. Inside
a key the index sorts fingerprints by Gray rank, factors the bits that all
members of a run share into upper nodes (mask and pattern), and compares nodes
from the top: the shared differing bits of two nodes are a lower bound for all
their members, and pairs of nodes beyond the limit go at once. Each key yields a
star per local component (never all pairs); components across keys are joined by
:mod:`genoframe.llm.components`.

Keys with more than ``BLOCK`` fingerprints are cut into runs of about that many, by
Gray rank and, where a key has very many, by hash; the tasks are pairs of runs that
the same bound does not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import cut, lookup_skewed
from genoframe.llm.components import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 16_384
#: Ranges of Gray rank that a large key is measured in; beyond so many blocks, ranges are cut by hash as well.
CELLS = 64
FANOUT = 8
#: Node pairs or rows looked at together in a task.
SLICE = 1 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64."""
    words = text.encode().translate(_FOLD).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(line, SEED)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    hashes = [hash64(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    return majority_bits(np.array(hashes, np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; none without any."""
    every = hashes.astype("<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(every), SLICE):
        part = every[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(every), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as a signed long) for every row; null and empty texts give 0."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(make, f"doc_id {kind}, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word (uint64) in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A forest of nodes over fingerprints, one tree for each group.

    ``levels[0]`` are the fingerprints in order of group and Gray rank; a node of
    the next level covers up to ``FANOUT`` of them and keeps the bits on which they
    agree (``mask``, ``pattern``).
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        pattern, group = codes[self.order], group[self.order]
        mask = np.full(len(codes), ~np.uint64(0))
        first = np.arange(len(codes))
        self.levels = [(mask, pattern, first, first + 1)]
        while len(np.unique(group)) < len(group):
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            within = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
            start = np.flatnonzero(within % FANOUT == 0)
            both = np.bitwise_and.reduceat(pattern | ~mask, start)
            some = np.bitwise_or.reduceat(pattern & mask, start)
            agreed = np.bitwise_and.reduceat(mask, start) & (both | ~some)
            pattern, mask, group = some & agreed, agreed, group[start]
            self.levels.append((mask, pattern, start, np.append(start[1:], within.size)))

    def components(self, limit: int, side: np.ndarray | None = None) -> np.ndarray:
        """For every fingerprint, the place (in input order) of one that its component shares."""
        n = len(self.order)
        label = np.arange(n)
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        if top:  # neighbours in Gray order first: dense groups join early
            _, _, first, last = self.levels[1]
            x = np.setdiff1d(np.arange(n - 1), last - 1)
            code = self.levels[0][1]
            x = x[np.bitwise_count(code[x] ^ code[x + 1]) <= limit]
            _unite(label, x, x + 1)
        while stack:
            level, a, b = stack.pop()
            if len(a) > (max(1, SLICE >> 6) if level == 1 else SLICE):
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            mask, pattern, first, last = self.levels[level]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            near = apart <= limit
            if level == 1:  # nodes whose members are all joined already need no further look
                least, most = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
                near &= (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
            a, b = a[near], b[near]
            if level == 0:
                _unite(label, a[a != b], b[a != b])
                continue
            ca, cb = last[a] - first[a], last[b] - first[b]
            many = ca * cb
            pair = np.repeat(np.arange(len(a)), many)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            x, y = first[a][pair] + k // cb[pair], first[b][pair] + k % cb[pair]
            keep = x <= y
            x, y = x[keep], y[keep]
            if level == 1:
                # Already joined ones need no further look.
                fresh = label[x] != label[y]
                x, y = x[fresh], y[fresh]
            stack.append((level - 1, x, y))
        out = np.empty(n, np.int64)
        out[self.order] = self.order[label]
        return out


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each pair the same, least label; labels stay flat."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _keys(n: int, limit: int) -> list[int]:
    """Masks of the keys: the fewest blocks that leave small groups of random codes."""
    for b in range(limit + 1, limit + 4):
        if n / 2 ** (64 * (b - limit) / b) <= 4096:
            break
    edges = [round(64 * k / b) for k in range(b + 1)]
    block = [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(block, b - limit)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _gray_rank_column(c: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def near_links(codes: DataFrame, limit: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Distinct ``fingerprint`` rows -> links (u, v) of fingerprints that join what is within ``limit`` bits.

    Not all pairs: links that give the same connected components.
    """
    n = codes.count()
    masks = _keys(n, limit)
    keyed = codes.select(
        "fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "part")
    )
    at = F.shiftrightunsigned(_gray_rank_column(F.col("fingerprint")), 1)
    edges = F.percentile_approx(at, F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), 1000)
    big = cut(keyed.groupBy("k", "part").agg(F.count("*").alias("n"), edges.alias("edges")).filter(F.col("n") > block))
    n_big = big.count()
    whole = {"i": F.lit(0), "j": F.lit(0), "own": F.lit(0)}
    if not n_big:
        return _local_links(keyed.withColumns(whole), limit)
    # At most len(masks) * n / block keys are that large.
    marked = keyed.join(F.broadcast(big) if n_big <= 10_000 else big, ["k", "part"], "left")
    small = marked.filter(F.col("n").isNull()).select("fingerprint", "k", "part").withColumns(whole)
    # As many runs as blocks: neighbouring cells together, or each cell in parts by hash.
    blocks = F.ceil(F.col("n") / block)
    cell, parts = F.size(F.filter("edges", lambda e: e < at)), F.ceil(blocks / CELLS)
    own = F.when(parts == 1, F.floor(cell * blocks / CELLS)).otherwise(cell * parts + F.pmod(F.xxhash64("fingerprint"), parts))
    runs = cut(marked.filter(F.col("n").isNotNull()).select("fingerprint", "k", "part", own.cast("int").alias("own")))
    nodes = cut(
        runs.groupBy("k", "part", "own").agg(
            F.expr("bit_and(fingerprint)").alias("both"), F.expr("bit_or(fingerprint)").alias("some")
        )
    )
    left = nodes.select("k", "part", F.col("own").alias("i"), F.col("both").alias("b1"), F.col("some").alias("s1"))
    right = nodes.select("k", "part", F.col("own").alias("j"), F.col("both").alias("b2"), F.col("some").alias("s2"))
    # Bits set in all of one run and in none of the other differ for all members.
    apart = F.bit_count(F.expr("(b1 & ~s2) | (b2 & ~s1)"))
    pairs = cut(left.join(right, ["k", "part"]).filter((F.col("i") <= F.col("j")) & (apart <= limit)).select("k", "part", "i", "j"))
    sides = pairs.select("k", "part", "i", "j", F.col("i").alias("own")).unionByName(
        pairs.filter("i < j").select("k", "part", "i", "j", F.col("j").alias("own"))
    )
    return _local_links(small, limit).unionByName(_local_links(runs.join(sides, ["k", "part", "own"]), limit))


def _local_links(rows: DataFrame, limit: int) -> DataFrame:
    """Stars of the components within each (k, part, i, j)."""
    key = ["k", "part", "i", "j"]

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        new = (p[key] != p[key].shift()).any(axis=1).to_numpy()
        codes = p["fingerprint"].to_numpy(np.int64).view(np.uint64)
        root = GrayIndex(codes, np.cumsum(new)).components(limit)
        away = root != np.arange(len(root))
        own = p["fingerprint"].to_numpy()
        return pd.DataFrame({"u": own[away], "v": own[root[away]]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows_held = 0
        for b in batches:
            held.append(b)
            rows_held += len(b)
            if rows_held < 200_000:
                continue
            p = pd.concat(held, ignore_index=True)
            last = (p[key] == p[key].iloc[-1]).all(axis=1).to_numpy()
            split = int(np.argmax(last))  # the last group may go on in the next batch
            if split:
                yield solve(p.iloc[:split].reset_index(drop=True))
            held, rows_held = [p.iloc[split:]], len(p) - split
        if rows_held:
            yield solve(pd.concat(held, ignore_index=True))

    dealt = rows.select("fingerprint", *key).repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key)
    return dealt.mapInPandas(link, "u long, v long")


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    limit: int = DISTANCE,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``documents``.

    Fingerprints within ``limit`` bits link; ``component_id`` is the least doc_id
    that links reach. Null, empty and blank texts have fingerprint 0 and link like
    any other. Repeated rows are returned as often as they come. Rows whose doc_id
    is null link like any other, so they may join others, and are returned with a null
    component. Other columns are not looked at; an empty table gives no rows.
    """
    found = cut(fingerprints(documents, id_col, text_col, shingle))
    codes = cut(found.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    joined = connected_components(near_links(codes.select("fingerprint"), limit, block))
    near = codes.join(joined, codes["fingerprint"] == joined["node"], "left")
    near = cut(near.select("fingerprint", "n", "rep", F.coalesce("component", "fingerprint").alias("component")))
    named = cut(near.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("many")))
    labels = cut(lookup_skewed(near, named, "component", "many").select("fingerprint", "n", "component_id"))
    out = lookup_skewed(found, labels, "fingerprint", "n")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
