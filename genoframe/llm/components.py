"""Connected components of a large graph, by alternating large-star and small-star.

Each round replaces links by links to smaller nodes until every component is a
star around its smallest node; the number of rounds is logarithmic in practice.
Hubs are safe: minima are pre-aggregated before the shuffle, and the links of a
hub meet its minimum in a join that broadcasts the few hottest hubs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import lookup_skewed, remove, written


def _smallest(links: DataFrame, made: list[str]) -> DataFrame:
    """(u, v) links -> (u, v, m): m is the least of u and its neighbours v."""
    least = written(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "stars", made)
    return lookup_skewed(links, least, "u", "n")


def connected_components(links: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(u, v) links between comparable nodes -> (node, component), least node first.

    Only nodes with a link are returned; self-links count. Links may repeat and
    may come in either direction. Each round lowers some node's least known neighbour
    or settles, so the rounds end by themselves. Rounds are tables in the shared folder, read
    again in as few tasks as their size asks for; those of a round go after it, the last one's path is added to ``made``.
    """
    spark, kept = links.sparkSession, []
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", kept)
    before = None
    while True:
        round_: list[str] = []
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, round_).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter(F.col("u") != F.col("v")).distinct(), "stars", round_)
        small = _smallest(large, round_)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        last, kept = kept, []
        links = written(small.filter(F.col("u") != F.col("v")).distinct(), "stars", kept)
        remove(spark, *round_, *last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    if made is not None:
        made += kept
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
