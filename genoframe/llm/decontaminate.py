"""Benchmark decontamination with an FM-index per training shard.

The executors take the documents of a partition in shards of a bounded number
of words, build an FM-index over each shard (suffix order by prefix doubling, a
wavelet tree over the last column, sampled suffix positions) and run a backward
search for every benchmark window. Occurrences are located through the sampled
positions and merged into removal spans per document.

Words that no benchmark item has cannot lie in an occurrence, so they end a run
of the shard's text, and runs shorter than the shortest window are left out of
the index; both steps are exact.

The benchmark is the stated query set. It is read to the driver in blocks of at
most ``BLOCK_ITEMS`` items and about ``BLOCK_CHARS`` characters, and each block is searched in all documents. With several
blocks the documents are written once with a number for each row; the first block
gives every row its result, the others only rows with an occurrence, which are merged
by that number. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import written

WINDOW = 13
#: Words indexed at a time; about 40 bytes of index and scratch memory a word.
SHARD_WORDS = 500_000
SAMPLE = 16
BLOCK_ITEMS = 20_000
#: Characters of items in a block, about; one longer item is a block of its own at most.
BLOCK_CHARS = 64_000_000

#: Bytes of words stay (A-Z in lower case), all others become spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


class WaveletTree:
    """Ranks over a sequence of small integers; one bit plane a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        self.planes: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            at = bit.astype(bool)
            cur = np.concatenate([cur[~at], cur[at]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``upto``, element by element."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.planes, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``at`` and their ranks before ``at``."""
        symbol, pos, lo = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for ones, zeros in zip(self.planes, self.zeros):
            one = ones[pos + 1] - ones[pos] == 1
            symbol = (symbol << 1) | one
            p, q = ones[pos], ones[lo]
            pos = np.where(one, zeros + p, pos - p)
            lo = np.where(one, zeros + q, lo - q)
        return symbol, pos - lo


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling over the suffixes still tied."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    ranked = text[sa]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    step = 1
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))  # slots whose suffix shares its rank
    while len(tied):
        at = sa[tied]
        follow = at + step
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + key
        order = np.argsort(both)
        at, both = at[order], both[order]
        sa[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        single = new & np.append(new[1:], True)
        tied = tied[~single]
        step *= 2
    return sa


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        """``text`` holds symbols from 1; 0 is kept for the end of the text."""
        text = np.append(text, 0)
        sa = suffix_order(text)
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.less = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.less[1:])
        self.marked = sa % sample == 0
        self.mark_rank = np.append(0, np.cumsum(self.marked))
        self.positions = sa[self.marked]
        self.n = len(text)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long windows (rows): ranges of suffixes."""
        lo = np.zeros(len(windows), np.int64)
        hi = np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[live, k]
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk to a sampled one and add the steps."""
        out, row = np.empty(len(rows), np.int64), rows.copy()
        left = np.arange(len(rows))
        steps = 0
        while len(left):
            here = self.marked[row]
            out[left[here]] = self.positions[self.mark_rank[row[here]]] + steps
            left, row = left[~here], row[~here]
            if len(left):
                c, r = self.tree.access(row)
                row = self.less[c] + r
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        # Items without an id are one item, which comes last and has no name.
        self.names: list[str | None] = sorted({str(i) for i, _ in items if i is not None})
        if any(i is None for i, _ in items):
            self.names.append(None)
        number = {n: k for k, n in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set[int]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            size = min(len(ids), window)
            for at in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(number[None if name is None else str(name)])
        self.by_size = {
            size: (np.array(list(rows), np.int64), [np.array(sorted(x), np.int64) for x in rows.values()])
            for size, rows in sorted(found.items())
        }
        self.shortest = min(self.by_size, default=0)


def shard_hits(texts: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: document number, word offset, window size and row.

    ``texts`` are the documents' word numbers, 1 for a word of no item.
    """
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    base = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
    offset = np.arange(len(flat)) - base[doc]
    # Runs of known words inside one document, long enough for a window.
    known = flat > 1
    start = known.copy()
    start[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    run = np.cumsum(start)
    length = np.bincount(run[known], minlength=(int(run[-1]) if len(run) else 0) + 1)
    kept = np.flatnonzero(known & (length[run] >= windows.shortest))
    nothing = (np.zeros(0, np.int64),) * 4
    if not len(kept):
        return nothing
    # A separator before each run, so that no occurrence spans two of them.
    fresh = start[kept]
    place = np.arange(len(kept)) + np.cumsum(fresh)
    text = np.ones(int(place[-1]) + 1, np.int64)
    text[place] = flat[kept]
    origin = np.zeros(len(text), np.int64)
    origin[place] = kept
    index = FMIndex(text, len(windows.vocabulary) + 2)
    out = []
    for size, (rows, _) in windows.by_size.items():
        lo, hi = index.search(rows)
        n = hi - lo
        which = np.repeat(np.arange(len(rows)), n)
        suffix = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        word = origin[index.locate(suffix)]
        out.append((doc[word], offset[word], np.full(len(word), size), which))
    return tuple(np.concatenate(x) for x in zip(*out))


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return list(zip(starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist()))


def find_contamination(
    documents: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_items: int = BLOCK_ITEMS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per row of ``documents``: id, ``n_words``, ``spans``, ``items``.

    ``spans``: merged word spans ``(start, end)``, end exclusive, covered by
    occurrences of windows; ``items``: ids (as strings, sorted) of the items
    whose windows occur. Items whose id is null are one item without a name: a null at the
    end of ``items``, counted, but not in the report's digest. A window is ``window`` consecutive item words; a shorter
    item is one window; an item without words has none. Null and empty texts have
    no words; repeated rows each give a row; an empty benchmark or an empty
    ``documents`` gives no spans or no rows. Other columns are not looked at.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    listed = items.select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    n_items, n_chars = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // block_items), -(-n_chars // block_chars))
    if n_blocks > 1:
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination")
    else:
        docs = docs.withColumn("row", F.lit(0).cast("long"))
    results = []
    for block in range(n_blocks):
        own = listed if n_blocks == 1 else listed.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block)
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()], window))
        rows = docs if block == 0 else docs.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "row")
        results.append(rows.mapInArrow(_searcher(shared, shard_words, every=block == 0), _schema(docs)))
    if n_blocks == 1:
        return results[0].drop("row")
    more = results[1]
    for r in results[2:]:
        more = more.unionByName(r)
    more = more.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    both = lambda c, d: F.when(F.col(d).isNull(), F.col(c)).otherwise(F.array_sort(F.array_distinct(F.concat(c, F.coalesce(d, c)))))
    merged = results[0].join(more, "row", "left").withColumns({"spans": both("spans", "_spans"), "items": both("items", "_items")})
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    union = F.aggregate(
        "spans",
        none,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return merged.withColumn("spans", F.when(F.col("_spans").isNull(), F.col("spans")).otherwise(union)).select("doc_id", "n_words", "spans", "items")


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"row long, doc_id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _searcher(shared, shard_words: int, every: bool = True):
    """Rows with their spans and items; without ``every`` only those that have some."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        number = windows.vocabulary.get

        def rows(numbers: list, ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            spans: list[list] = [[] for _ in ids]
            items: list[list] = [[] for _ in ids]
            # Equal texts in a shard are indexed once.
            seen: dict[bytes, int] = {}
            same = [seen.setdefault(t.tobytes(), k) for k, t in enumerate(texts)]
            own = sorted(set(same))
            if windows.by_size:
                doc, at, size, row = shard_hits([texts[k] for k in own], windows)
                order = np.argsort(doc, kind="stable")
                doc, at, size, row = doc[order], at[order], size[order], row[order]
                cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
                for a, b in zip(cuts, [*cuts[1:], len(doc)]):
                    k = own[doc[a]]
                    spans[k] = [{"start": s, "end": e} for s, e in _merge(at[a:b], at[a:b] + size[a:b])]
                    pairs = set(zip(size[a:b].tolist(), row[a:b].tolist()))
                    found = {int(i) for n, r in pairs for i in windows.by_size[n][1][r]}
                    items[k] = [windows.names[i] for i in sorted(found)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int64()),
                    pa.array(ids, kind),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([spans[k] for k in same], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([items[k] for k in same], pa.list_(pa.string())),
                ],
                names=["row", "doc_id", "n_words", "spans", "items"],
            )
            return out if every else out.filter(pa.array([bool(spans[k]) for k in same]))

        numbers, ids, texts, held, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.column("doc_id").type
            for row, doc_id, text in zip(batch.column("row"), batch.column("doc_id"), batch.column("text")):
                words = words_of(text.as_py())
                numbers.append(row.as_py())
                ids.append(doc_id.as_py())
                texts.append(np.fromiter((number(w, 1) for w in words), np.int32, len(words)))
                held += len(words)
                if held >= shard_words:
                    yield rows(numbers, ids, texts)
                    numbers, ids, texts, held = [], [], [], 0
        if ids:
            yield rows(numbers, ids, texts)

    return search


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts and the verdict per document, from the spans of ``find_contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
