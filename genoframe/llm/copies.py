"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node. SimHash fingerprints of the sets go through the Gray-order
index of :mod:`genoframe.llm.simhash` first, which joins what differs in few bits. At a
similarity of 0.8 two fingerprints of 64 bits differ in some ten bits, beyond any limit
that an index can be cut by, so what the index leaves apart meets in buckets as well, one
for each of ``BANDS`` bands of ``ROWS`` minimum hashes; a pair of similarity s shares none
with a chance of (1 - s^4)^32, 5e-8 at 0.8 and less above. Every link is confirmed on the
whole sets. In ``ROUNDS`` rounds, each bucket whose members are not yet of one component
compares them with one leader, drawn anew; then the pairs still apart are compared one by
one, a large bucket in blocks. No bucket is dropped or capped.

Whole sets are made only of texts that share a bucket or that the index pairs. Before two
of them meet, a bound rules out most pairs: the odd sketch of a set, ``ODD`` bits, has a
bit for the parity of the number of its hashes in each of as many parts, so the bits in
which two sketches differ are no more than the hashes that only one of the sets has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import let, lookup_skewed, possibly, remove, written
from genoframe.llm.components import connected_components
from genoframe.llm.simhash import _FOLD, DISTANCE, SEED, majority_bits, near_links

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
#: Shingles hashed together, and rounds with leaders.
SLICE, ROUNDS = 4096, 2
#: Bits of an odd sketch; pairs of one node, and nodes of one bucket, that are compared under one key.
ODD, SPLIT = 1024, 2048

_rng = np.random.default_rng(SEED)
_FLIP, _TIMES = (_rng.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode().translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.array([hash64(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys (int64) of the buckets that a set of shingles falls into."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), SLICE):
        x = (found[at : at + SLICE] ^ _FLIP) * _TIMES
        x ^= x >> np.uint64(29)
        np.minimum(least, x.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """``ODD`` bits as int64: the parity of the number of hashes in each part."""
    counts = np.bincount((found >> np.uint64(20)).astype(np.int64) % ODD, minlength=ODD)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(rows: DataFrame, made: list[str]) -> DataFrame:
    """(key, text) -> (key, node, size, fingerprint, bands), written to the shared folder."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingles(t.as_py()) for t in part.column("text")]
                node = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], np.uint64).view(np.int64)
                bits = np.array([majority_bits(f) for f in found], np.uint64).view(np.int64)
                keys = pa.array([bands(f) for f in found], pa.list_(pa.int64()))
                size = pa.array([len(f) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(node), size, pa.array(bits), keys], names=["key", "node", "size", "fingerprint", "bands"]
                )

    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.mapInArrow(make, f"key {kind}, node long, size long, fingerprint long, bands array<long>"), "copies", made)


def _sets(rows: DataFrame, wanted: DataFrame, made: list[str]) -> DataFrame:
    """(key, text) and the written (key, node, n) -> (node, size, odd, shingles) of each wanted node, written.

    ``n``: how many rows of ``rows`` have the key, at most. Keys with over a thousandth of
    the rows, a thousand at most, are found by a broadcast; their rows are one before the shuffle.
    Texts of no such key are not shuffled, but for the few that :func:`possibly` lets pass.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingles(t.as_py()) for t in part.column("text")]
                size = pa.array([len(f) for f in found], pa.int64())
                odd = pa.array([odd_sketch(f) for f in found], pa.list_(pa.int64()))
                whole = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), size, odd, whole], names=["node", "size", "odd", "shingles"])

    least = max(1000, (wanted.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot, cold = wanted.filter(F.col("n") > least).select("key", "node"), wanted.filter(F.col("n") <= least).select("key", "node")
    rows = possibly(rows, wanted, "key").filter("_possible").drop("_possible")
    if hot.isEmpty():
        texts = rows.join(cold, "key")
    else:
        few = F.broadcast(hot)
        texts = rows.join(few, "key").unionByName(rows.join(few.select("key"), "key", "left_anti").join(cold, "key"))
    texts = texts.groupBy("key", "node").agg(F.any_value("text").alias("text")).select("node", "text")  # a node has one key, so the join's order serves
    return written(texts.mapInArrow(make, "node long, size long, odd array<long>, shingles array<long>"), "copies", made)


def _within(least: float, size: str, size2: str, odd: str, odd2: str) -> Column:
    """Whether two sets can be alike enough, by their sizes and odd sketches: never false for a pair that is."""
    apart = sum((F.bit_count(F.get(odd, F.lit(k)).bitwiseXOR(F.get(odd2, F.lit(k)))) for k in range(ODD // 64)), F.lit(0))
    near = F.least(size, size2) >= least * F.greatest(size, size2)
    return near & (apart <= (1 - least) / (1 + least) * (F.col(size) + F.col(size2)) + 1e-6)


def _beside(pairs: DataFrame, written_pairs: DataFrame, sets: DataFrame, side: str, name: str, made: list[str]) -> DataFrame:
    """The pairs, the same as written, with the set of their ``side``; a node with many pairs is dealt over several keys, so no set is broadcast."""
    counts = written(written_pairs.groupBy(side).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / SPLIT).cast("int")), "copies", made)
    dealt = lookup_skewed(pairs, counts, side, "n").withColumn("part", F.pmod(F.xxhash64("v" if side == "u" else "u"), "parts").cast("int"))
    facts = sets.select(F.col("node").alias(side), F.col("shingles").alias(name)).join(counts.select(side, "parts"), side)
    facts = facts.select(side, name, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(facts, [side, "part"]).drop("parts", "part")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float, made: list[str]) -> DataFrame:
    """The written pairs (u, v) whose whole sets are alike enough, after the bound. All inside the JVM, a pair at a time."""
    given = pairs
    for side, size, odd in (("u", "size", "odd"), ("v", "size2", "odd2")):
        facts = given.groupBy(side).agg(F.count("*").alias("n"))
        facts = facts.join(sets.select(F.col("node").alias(side), F.col("size").alias(size), F.col("odd").alias(odd)), side)
        pairs = lookup_skewed(pairs, written(facts, "copies", made), side, "n")  # a sketch has some hundred bytes
    left = pairs = written(pairs.filter(_within(least, "size", "size2", "odd", "odd2")).select("u", "v"), "copies", made)
    for side, name in (("u", "x"), ("v", "y")):
        pairs = _beside(pairs, left, sets, side, name, made)
    shared = let(F.size(F.array_intersect("x", "y")), lambda n: n >= least * (F.size("x") + F.size("y") - n))
    return pairs.filter(shared).select("u", "v")


def _blocked(members: DataFrame, sets: DataFrame, least: float, made: list[str]) -> DataFrame:
    """(bucket, node, many, component) -> the pairs (u, v) of a bucket, apart in component, that the bound leaves.

    A bucket of ``many`` nodes is dealt over as many keys as it has blocks of ``SPLIT``;
    each meets all its nodes. Both conditions are the join's own, so no other pair is made.
    """
    members = written(members.join(sets.select("node", "size", "odd"), "node"), "copies", made)
    parts = F.ceil(F.col("many") / SPLIT).cast("int")
    a = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("many")
    b = members.select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}2") for c in ("node", "component", "size", "odd")])
    apart = (F.col("node") < F.col("node2")) & (F.col("component") != F.col("component2"))
    pairs = a.join(b, ["bucket", "part"]).filter(apart & _within(least, "size", "size2", "odd", "odd2"))
    return pairs.select(F.col("node").alias("u"), F.col("node2").alias("v"))


def _indexed(one: DataFrame, made: list[str]) -> DataFrame:
    """Candidate pairs (u, v) of nodes from the Gray-order index: a node and the first of its fingerprint, and the first ones that the index links."""
    own = one.filter("size > 0").select("node", "fingerprint")
    first = written(own.groupBy("fingerprint").agg(F.min("node").alias("first"), F.count("*").alias("n")), "copies", made)
    same = lookup_skewed(own, first, "fingerprint", "n").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    links = near_links(first.select("fingerprint"), DISTANCE)
    name = lambda c, to: first.select(F.col("fingerprint").alias(c), F.col("first").alias(to))
    far = links.withColumnsRenamed({"u": "fu", "v": "fv"}).join(name("fu", "u"), "fu").join(name("fv", "v"), "fv").select("u", "v")
    return same.unionByName(far)


def copy_groups(rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(key, text) -> (key, group) for the least key of each set of shingles.

    Sets of similarity ``least`` or more link; a group is what links reach. Null and
    blank texts are one set. Keys of the same set that are not the least do not come back.
    """
    made: list[str] = []
    kept = lambda df: written(df, "copies", made)  # noqa: E731  (unlike a checkpoint, no constraints of its plan pile up over the rounds)
    rows = rows.select("key", "text")
    found = _sketches(rows, made)
    facts = {"size": F.max("size"), "fingerprint": F.max("fingerprint"), "bands": F.any_value("bands")}
    one = kept(found.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("n"), *[v.alias(c) for c, v in facts.items()]))
    keyed = one.select("node", "size", F.explode("bands").alias("bucket"))
    shared = kept(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = kept(lookup_skewed(keyed, shared, "bucket", "n"))
    indexed = kept(_indexed(one, made).distinct())
    meeting = members.select("node").unionByName(indexed.select(F.col("u").alias("node"))).unionByName(indexed.select(F.col("v").alias("node"))).distinct()
    sets = _sets(rows, kept(one.select("key", "node", "n").join(meeting, "node", "left_semi")), made)
    near = F.least("size", "size2") >= least * F.greatest("size", "size2")
    links = kept(_confirmed(indexed, sets, least, made))
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    if not links.isEmpty():
        labels = connected_components(links, made)
    for r in range(ROUNDS + 1):
        own = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        leader = F.min_by(F.struct("node", "size", "component"), F.struct(F.xxhash64("node", F.lit(r)), "node")).alias("leader")
        open_ = own.groupBy("bucket").agg(F.count("*").alias("many"), leader, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        open_ = kept(open_.select("bucket", "many", F.col("leader.node").alias("node2"), F.col("leader.size").alias("size2"), F.col("leader.component").alias("component2")))
        most = open_.agg(F.max("many")).first()[0] or 0
        if not most:
            break
        last = r == ROUNDS or most == 2
        if last and most > 2:
            rest = lookup_skewed(own.drop("size"), open_.select("bucket", "many", F.col("many").alias("weight")), "bucket", "weight")
            pairs = _blocked(rest, sets, least, made)
        else:
            across = lookup_skewed(own, open_, "bucket", "many")
            pairs = across.filter(near & (F.col("component") != F.col("component2"))).select(F.col("node2").alias("u"), F.col("node").alias("v"))
        fresh = kept(_confirmed(kept(pairs.distinct()), sets, least, made))
        if not fresh.isEmpty():
            links = kept(links.unionByName(fresh))
            labels = connected_components(links, made)
        if last:
            break
    out = written(one.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("group")), "copies")
    remove(out.sparkSession, *made)
    return out
