"""Mixing sources to target weights: whole documents are taken until each source's words come to its target.

Documents are counted by exact length. A source whose target passes its size is taken
whole as often as fits; what is left of the budget is filled by lengths: most of it in
proportion to the source's own lengths, the rest by bounded-knapsack dynamic
programming, which finds the sum nearest to the budget. How many documents of a length
are taken is then known, and which ones is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.common import cut

#: Words of a source's budget that the dynamic programme fills, over lengths that the proportional part left.
RESERVE = 8192
#: Ranges of the seeded hash in which documents of one length are counted.
BUCKETS = 1 << 16


def fitted_counts(lengths: list[int], counts: list[int], budget: int, reserve: int = RESERVE) -> list[int]:
    """How many documents of each length to take, at most ``counts``, for a sum near ``budget``.

    The budget less ``reserve`` is dealt from the longest length to the shortest in
    proportion to their words, what a length cannot take going on to the next. The
    dynamic programme then fills what is left exactly, or with the sum nearest to it
    (the smaller of two) that the documents left can make. Its table holds twice the
    words left: those of the reserve, or of a document where all shorter ones are taken.
    """
    order = sorted((k for k, length in enumerate(lengths) if length > 0), key=lambda k: -lengths[k])
    take, given, seen = [0] * len(lengths), 0, 0
    words, bulk = sum(lengths[k] * counts[k] for k in order), max(0, budget - reserve)
    for k in order:
        seen += lengths[k] * counts[k]
        take[k] = min(counts[k], (bulk * seen // words - given) // lengths[k])
        given += take[k] * lengths[k]
    left = budget - given
    origin = np.full(2 * left + 1, -1, "int32")  # the first item by which a sum is reached
    reached = np.zeros(2 * left + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in order:
        spare, size = min(counts[k] - take[k], 2 * left // lengths[k]), 1
        while spare > 0 and not reached[left]:
            n = min(size, spare)
            step = n * lengths[k]
            fresh = np.flatnonzero(reached[: len(reached) - step] & ~reached[step:]) + step
            origin[fresh], reached[fresh] = len(items), True
            items.append((k, n))
            spare, size = spare - n, 2 * size
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        k, n = items[origin[at]]
        take[k] += n
        at -= n * lengths[k]
    return take


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point of ``source``, null last. Rows are sorted by ranges; a count of each range comes to the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = cut(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = sources.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(offset, "_part").withColumn("rank", F.col("_offset") + nth - 1).drop("_part", "_offset")


def targets(sources: DataFrame, weights: list[int], most: int) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sources`` (source, source_size).

    Targets share the sum of all sizes by weight; where that is over ``most`` times a
    source's size the source gets just that, and the excess goes to the others by
    weight, until none is above. Each round is one sum over the sources and settles some of them.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(_ranked(sources).withColumn("weight", weight.cast("long")))
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    most_of = F.col("source_size") * most
    wide = lambda c: c.cast("decimal(19,0)")
    above, part, of, n_above = F.lit(False), 0, 1, -1
    while True:
        free, capped, n = rows.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, most_of)), F.count_if(above)).first()
        if not free or n == n_above:
            break
        part, of, n_above = whole - (capped or 0), free, n  # a weight of 1 gets part / of words
        above = wide(F.col("weight")) * wide(F.lit(part)) > wide(most_of) * wide(F.lit(of))
    shared = (F.col("weight") * F.lit(part)).cast("double") / F.lit(of)
    return rows.withColumn("target", F.least(shared, most_of.cast("double")))


def mixed(docs: DataFrame, *, weights: list[int] = [1, 2, 3], most: int = 3, seed: int = 13) -> DataFrame:  # noqa: B006
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source).

    ``size``: words of the text, 0 for null; ``taken``: words of it in the mix, repeats
    counted. Weights go round by the sources' order. A document is taken as often as its
    source fits whole into its target, or once more. Rows with null source are a source;
    null ids are ids like others. Rows equal in doc_id and text stand in one range of the
    hash; which of them is taken does not show. No row gives no row.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = cut(docs.select("doc_id", "source", words.alias("size"), h.alias("h"), F.shiftrightunsigned(h, 48).cast("int").alias("bucket")))
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))  # null is a key of its own
    cells = cut(rows.groupBy("src", "size", "bucket").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    lengths = cells.groupBy("src", "size").agg(F.first("source").alias("source"), F.sum("n").alias("n"))
    sources = lengths.groupBy("src").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    planned = lengths.drop("source").join(targets(sources, weights, most).select("src", "source_size", "target"), "src")
    fitted = planned.groupBy("src").applyInPandas(_fit(most), "src string, size long, source_size long, target double, times long, more long")
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.drop("source").withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.join(fitted, ["src", "size"]).withColumn("_here", F.col("more") - F.col("_before")).drop("n", "more", "_before")
    nth = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id"))
    taken = (F.col("times") + (nth <= F.col("_here")).cast("long")) * F.col("size")
    return rows.join(cells, ["src", "size", "bucket"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _fit(most: int):
    """A source's lengths (as many rows as it has different ones) with whole times and how many documents of a length are taken once more."""

    def fit(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        size, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
        times = min(most, int(target // size)) if size else 0
        budget = 0 if times == most else min(size, round(target - times * size))
        more = fitted_counts(lengths["size"].tolist(), lengths["n"].tolist(), budget) if budget > 0 else 0
        return lengths.drop(columns="n").assign(times=times, more=more)

    return fit
