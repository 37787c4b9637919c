"""Document fingerprints from closed syncmers, in DataFrame and SQL functions alone.

A text is its words (runs of letters and digits, lower case). A k-mer of ``K``
words is a closed syncmer if, of its inner runs of ``S`` words, the one of least
hash lies at its start or end. Whether a k-mer is chosen depends on its own words
only, so an edit moves anchors near it and no others. The fingerprint keeps the
``SIZE`` anchors of least hash with their word positions; likeness is the share of
anchors that two fingerprints have in common at matching positions. ``SIZE`` is a
parameter, not a cap on the text: all its anchors compete, and a likeness p read off
48 of them has a standard error of sqrt(p (1 - p) / 48), 0.07 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.common import let

K, S, SIZE = 6, 3, 48
#: Anchors are longs: 32 bits of hash above 31 bits of position, which no text can exceed.
_BITS = 31
_POSITION = 1 << _BITS
#: Rows to a bucket when neighbours by id are looked for, and buckets at most: what the driver holds of the ids.
BUCKET_ROWS, MOST_BUCKETS = 256, 16_384


def anchors(text: Column, size: int = SIZE, least: bool = False) -> Column:
    """Sorted anchors (longs) of a text; a text of fewer than ``K`` words, but not none, is one k-mer.

    A text of ``K`` words or some more may have no closed syncmer: it has no anchor, or
    with ``least`` the k-mer of least hash, so that only texts without words have none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    inner = let(
        hashed,
        lambda h: F.when(
            F.size(h) >= K,
            F.transform(F.slice(h, 1, F.size(h) - (S - 1)), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
        ).otherwise(F.when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))),
    )

    def choose(m: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            b, c, d = F.get(m, i + 1), F.get(m, i + 2), F.get(m, i + 3)
            edge = d.isNotNull() & (((x <= b) & (x <= c) & (x <= d)) | ((d <= x) & (d <= b) & (d <= c)))
            return F.when(edge, _code(F.xxhash64(x, d), i))

        many = F.filter(F.transform(m, at), lambda x: x.isNotNull())
        if least:
            every = F.transform(F.slice(m, 1, F.size(m) - 3), lambda x, i: _code(F.xxhash64(x, F.get(m, i + 3)), i))
            many = let(many, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.array_min(every))))
        alone = F.array(_code(F.get(m, F.lit(0)), F.lit(0)))
        return F.when(m.isNull(), F.expr("cast(array() as array<bigint>)")).when(F.size(m) < 4, alone).otherwise(many)

    distinct = let(
        F.array_sort(let(inner, choose)),
        lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(a, i - 1)))),
    )
    return F.slice(distinct, 1, size)


def _code(hashed: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 32), _BITS).bitwiseOR(position.cast("long"))


def _hash(code: Column) -> Column:
    return F.shiftright(code, _BITS)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """0 to 1: of the least anchors of both, the share that both have at matching positions.

    Positions match if their shift is within an eighth of the longer text, or 32
    words, of the middle shift. Two fingerprints without anchors are alike.
    """

    def compare(ha: Column, hb: Column) -> Column:
        least = F.slice(F.array_sort(F.array_union(ha, hb)), 1, size)
        shared = F.array_intersect(least, F.array_intersect(ha, hb))
        shift = F.transform(
            shared,
            lambda h: F.get(a, F.array_position(ha, h).cast("int") - 1) % _POSITION - F.get(b, F.array_position(hb, h).cast("int") - 1) % _POSITION,
        )
        reach = F.greatest(
            F.lit(32),
            F.floor(F.greatest(F.array_max(F.transform(a, lambda x: x % _POSITION)), F.array_max(F.transform(b, lambda x: x % _POSITION))) / 8),
        )
        matched = let(
            shift,
            lambda s: let(F.get(F.array_sort(s), F.floor(F.size(s) / 2).cast("int")), lambda mid: F.size(F.filter(s, lambda x: F.abs(x - mid) <= reach))),
        )
        return F.when(F.size(shared) == 0, 0.0).otherwise(matched / F.size(least))

    both = let(F.transform(a, _hash), lambda ha: let(F.transform(b, _hash), lambda hb: compare(ha, hb)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def spelt(a: Column) -> Column:
    """``hash@position`` of each anchor (8 hex digits), blank-joined; "" without anchors."""
    return F.array_join(
        F.transform(
            a, lambda x: F.concat(F.lpad(F.lower(F.hex(_hash(x))), 8, "0"), F.lit("@"), (x % _POSITION).cast("string"))
        ),
        " ",
    )


def _edges(keys: DataFrame, buckets: int) -> Column:
    """A literal array of about ``buckets`` - 1 (id, hash) structs that cut the ordered keys into parts of like size.

    Eight times as many distinct keys are drawn by hash, a bounded number whatever the
    table, and every eighth is taken. Edges decide who meets whom, not what is found.
    """
    n = keys.count()
    buckets = max(1, min(buckets, -(-n // BUCKET_ROWS)))
    drawn = keys.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), "h"), F.lit(max(1, n // (8 * buckets)))) == 0).distinct()
    every_eighth = F.filter(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda _, i: i % 8 == 7)
    text = drawn.agg(F.to_json(every_eighth)).first()[0]
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in keys.schema.fields)
    return F.from_json(F.lit(text or "[]"), f"array<struct<{fields}>>")


def _place(edges: Column, key: Column) -> Column:
    """How many edges are not above the key, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(MOST_BUCKETS.bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= key, at + step).otherwise(at))


def with_next(rows: DataFrame, id_col: str, carried: list[str], order: str) -> DataFrame:
    """Rows with buckets for :func:`next_of`: ranges of (id, hash of ``order``), any type of id.

    The head of each bucket, its largest row, is also sent to the bucket before it (of
    the first to the last), so no task holds more than a range and one head.
    """
    # A hot id is split by the hash of ``order``; only rows equal in both stay together.
    keyed = rows.withColumns({"_h": F.xxhash64(order)})
    edges = _edges(keyed.select(F.col(id_col).alias("id"), F.col("_h").alias("h")), MOST_BUCKETS)
    keyed = keyed.withColumn("_bucket", _place(edges, F.struct(F.col(id_col).alias("id"), F.col("_h").alias("h"))))
    every = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # MOST_BUCKETS rows at most
    filled = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    receiver = filled.select("_bucket", F.coalesce(F.lead("_bucket").over(every), F.first("_bucket").over(every)).alias("_to"))
    heads = keyed.groupBy("_bucket").agg(F.max(F.struct(id_col, "_h", *carried)).alias("_top")).join(F.broadcast(receiver), "_bucket")
    heads = heads.select("_top.*", F.col("_to").alias("_bucket"), F.lit(True).alias("_head"))
    return keyed.withColumn("_head", F.lit(False)).unionByName(heads)


def next_of(prepared: DataFrame, id_col: str, carried: list[str], order: str) -> DataFrame:
    """Adds ``next``: the ``carried`` columns of the row that follows by falling id; after the last the first.

    Null ids come last; equal ids go by falling hash of ``order``, then falling ``order``.
    ``prepared`` comes from :func:`with_next`, with more columns computed since.
    """
    falling = Window.partitionBy("_bucket").orderBy("_head", F.desc(id_col), F.desc("_h"), F.desc(order))
    named = prepared.withColumn("next", F.lead(F.struct(*carried)).over(falling))
    return named.filter(~F.col("_head")).drop("_head", "_bucket", "_h")


def edited_fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text: the last third of the code points (rounded down) replaced by
    the first as many of the next text by falling id, or by all it has. Null texts
    are empty; empty texts have no anchors; a single row is its own next; repeated
    rows each give a row; an empty table gives none. Other columns are not looked at.
    Ids may be of any type that can be ordered. ``least``: see :func:`anchors`.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prepared = with_next(rows, "doc_id", ["text"], "text").withColumn("a", anchors(F.col("text"), least=least))
    both = next_of(prepared, "doc_id", ["text", "a"], "text")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.col("next.text"), F.lit(1), cut))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "a", F.col("next.a").alias("next_a"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "a", "next_a", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), anchors(F.col("edited"), least=least).alias("e"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelt(F.col("a")).alias("fingerprint"),
        spelt(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"),
        likeness(F.col("a"), F.col("next_a")).alias("near_next"),
    )
