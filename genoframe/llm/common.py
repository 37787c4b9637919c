"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.shared import remove, scratch, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from what was written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup_skewed(rows: DataFrame, facts: DataFrame, key: str, weight: str, hot_share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one fact row per ``key``, safe for hot keys.

    ``weight`` is the column of ``facts`` that says how many rows a key has.
    Keys with more than 1/``hot_share`` of all rows can be at most
    ``hot_share`` in number, which bounds what is broadcast; every other key is
    joined by shuffling. ``facts`` is read three times: hand over a written one.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    least = max(1000, total // hot_share)
    facts = facts.select("*")
    hot = facts.filter(F.col(weight) > least).drop(weight)
    keys = [r[0] for r in hot.select(key).collect()]  # at most hot_share of them
    rest = facts.filter(F.col(weight) <= least).drop(weight)
    if not keys:
        return rows.join(rest, key)
    is_hot = F.col(key).isin(keys)
    return rows.filter(is_hot).join(F.broadcast(hot), key).unionByName(rows.filter(~is_hot).join(rest, key))


#: Bits of the filter that :func:`possibly` broadcasts, as a power of two.
FILTER_BITS = 24


def possibly(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_possible``: false only where ``key`` is in no row of ``keys``, so that such rows need no shuffle.

    Keys are hashed to ``2 ** FILTER_BITS`` bits, which are broadcast whatever the size (262,144
    words at most); the fuller they are the more other rows pass too, and a join settles those.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).alias("_place")
    word, bit = F.expr("_place div 64").alias("_word"), F.expr("shiftleft(1L, cast(_place % 64 as int))")
    marks = keys.select(place).groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_place", place).withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    return marked.withColumn("_possible", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_word", "_bits")
