"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Executors tokenise whole texts (equal words once) and cut documents of more than
``capacity`` ids into pieces. Pieces are packed in groups of a bounded number:
each piece goes where the sum of the squared counts of open bins per residual
gap becomes smallest. Pieces of a group come by falling length, so that what is
left open at the end is small. The number of groups follows the input.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import cut

CAPACITY = 4096
#: Pieces packed together in a task; some tens of bytes each.
GROUP_PIECES = 32_768
END_ID = 1
#: Words remembered by a worker, in each of two generations.
CACHE_WORDS = 250_000
#: Longer words are encoded anew each time, so that a worker's memory has a bound.
CACHE_LETTERS = 64
_ENDS = ".,;:!?%#&*$"


class _Memory(dict):
    """Ids by word; an unknown word is looked up in the older generation, else encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            core = word.rstrip(_ENDS)
            if core.isascii() and core.isalpha() and (core != word or not core.islower()):
                # Letters, then marks: the pre-tokenizer parts them, and case is dropped.
                found = self[core.lower()] + (self[word[len(core) :]] if core != word else b"")
            else:
                found = self.encode(word)
        if len(word) <= CACHE_LETTERS:
            self[word] = found
        return found


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file whose pre-tokenizer never spans blanks.

    Such a file lower-cases, drops white space, and parts letters from marks (as
    ``word_bpe_49k.json`` does). ``encode`` gives little-endian unsigned 32-bit ids.
    Texts are taken apart at spaces and newlines, and the ids of a word are kept
    for its next occurrence, in two generations of bounded size.
    """

    _made: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        self.known = _Memory(self._encode, {})

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        """One for each worker process, so that later tasks find known words."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, word: str) -> bytes:
        if word.isascii() and word.islower() and word.isalpha():
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.inner.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) > CACHE_WORDS:
            self.known = _Memory(self._encode, dict(self.known))
        known = self.known
        return b"".join([known[w] for w in text.replace("\n", " ").split(" ")])


def token_pieces(
    documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.

    A document is its ids, then ``END_ID``; null and empty texts are that id
    alone. Only what is longer than ``capacity`` is cut. Repeated rows give
    repeated pieces.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.of(tokenizer)
        for b in batches:
            out = []
            for row, text in enumerate(b.column("text")):
                ids = coder.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            row, piece, start, length, crc = map(list, zip(*out)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(tokenise, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, in the order given.

    ``count[g]`` bins are open with gap ``g``. A piece of length s that goes into a
    bin of gap g changes the sum of squares by 2 (count[g - s] - count[g]) + 2, or
    by 1 - 2 count[g] if it fills the bin; a new bin changes it by 2 count[C - s] + 1.
    Of equal choices the smallest gap is taken, a new bin last.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        if s >= capacity:
            bins[k], offsets[k], n = n, 0, n + 1
            continue
        now = count[s:capacity]
        change = 2 * (count[: capacity - s] - now) + 2
        change[0] = 1 - 2 * now[0]
        change[now == 0] = far
        at = int(change.argmin())
        if change[at] <= 2 * count[capacity - s] + 1:
            gap = s + at
            which = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, which, n = capacity, n, n + 1
        bins[k], offsets[k] = which, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(which)
    return bins, offsets


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``length`` (1 to ``capacity``).

    Pieces are dealt to groups by a hash of their place, about ``group_pieces`` to a
    group, so a group's size is bounded whatever the input. Other columns stay.
    """
    pieces = cut(pieces)  # the dealing needs their number
    groups = max(1, -(-pieces.count() // group_pieces))
    # Repeated rows would hash alike: a running number within the task tells them apart.
    numbered = pieces.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def fill(p: pa.Table) -> pa.Table:
        lengths = p.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        bins, offsets = sum_of_squares(lengths[order], capacity)
        group = p.column("_g")[0].as_py()
        p = p.drop_columns(["_g"]).take(pa.array(order))
        return p.append_column("sequence_id", pa.array(bins * groups + group)).append_column("offset", pa.array(offsets))

    return numbered.groupBy("_g").applyInArrow(fill, schema)


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and the share of places used."""
    return packed.agg(
        F.countDistinct("sequence_id").alias("sequences"),
        F.sum("length").alias("tokens"),
        (F.sum("length") / (F.countDistinct("sequence_id") * F.lit(capacity))).alias("fill"),
    )
