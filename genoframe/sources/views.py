"""Variant tables over the warehouse tables: sites, genotypes, intervals.

Both engines of the correctness check build them from the same plain expressions,
given here once as SQL text that Spark and DuckDB read alike. A site is an order:
five of them, one on each contig, share a position, so a key without the contig mixes
them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = "substr('ACGT', cast(1 + o_orderkey % 4 as int), 1)"
_ALT = "substr('ACGT', cast(1 + (o_orderkey + 1 + o_custkey % 3) % 4 as int), 1)"
_ALT2 = "substr('ACGT', cast(1 + (o_orderkey + 1 + (o_custkey + 1) % 3) % 4 as int), 1)"
_TAIL = f"repeat({_ALT}, cast(1 + o_orderkey % 3 as int))"
#: The contig and position of an order's key; positions are 2 to 5 apart.
_NTH = "cast(({0} - {0} % 5) / 5 as bigint)"
_PLACE = f"cast({{0}} % 5 as int) AS chrom, 4 * {_NTH} + {_NTH} % 3 + 1 AS pos"
#: kind 0, 3: SNP; 1: insertion; 2: deletion; 3 has a second ALT.
SITES = f"""SELECT {_PLACE.format('o_orderkey')}, o_orderkey AS rec,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('rs', cast(o_orderkey as varchar(20))) END AS id,
 CASE WHEN o_custkey % 4 = 2 THEN concat({_REF}, {_TAIL}) ELSE {_REF} END AS ref,
 CASE WHEN o_custkey % 4 = 1 THEN concat({_REF}, {_TAIL}) WHEN o_custkey % 4 = 2 THEN {_REF} ELSE {_ALT} END AS alt,
 CASE WHEN o_custkey % 4 = 3 THEN {_ALT2} END AS alt2,
 o_totalprice / 1000 AS qual, o_orderstatus AS filter, cast(o_custkey % 4 as int) AS kind, o_custkey AS src
FROM orders"""

GENOTYPES = f"""SELECT {_PLACE.format('l_orderkey')}, l_linenumber AS sample, cast(l_partkey % 2 as int) AS a, cast(l_suppkey % 2 as int) AS b,
 cast(l_quantity as int) AS dp, l_extendedprice AS gq, l_returnflag = 'R' AS phased
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) t
WHERE rn = 1"""

INTERVALS = f"""SELECT p_partkey AS name, cast(p_partkey % 5 as int) AS chrom, 29 * {_NTH.format('p_partkey')} AS from1,
 29 * {_NTH.format('p_partkey')} + p_size AS to1, p_brand AS label FROM part"""


def sql_view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Run ``text`` over named tables of ``sf_dir`` without touching the session's catalog."""
    frames = {}
    for t in tables:
        frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_view(spark, sf_dir, SITES, "orders")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (site, sample), the least of repeated ones.

    Only the columns that decide are read. Rows are dealt out by site once: grouping by
    sample, matrices and joins by site all follow that partitioning without another shuffle.
    """
    rest = "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_shipdate l_returnflag l_linestatus".split()
    nth = F.expr("l_orderkey div 5")
    place = {"chrom": (F.col("l_orderkey") % 5).cast("int"), "pos": 4 * nth + nth % 3 + 1}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *rest).withColumns(place).repartition("chrom", "pos")
    first = rows.groupBy("chrom", "pos", "l_linenumber").agg(F.min(F.struct(*rest)).alias("x"))
    return first.select(
        "chrom",
        "pos",
        F.col("l_linenumber").alias("sample"),
        (F.col("x.l_partkey") % 2).cast("int").alias("a"),
        (F.col("x.l_suppkey") % 2).cast("int").alias("b"),
        F.col("x.l_quantity").cast("int").alias("dp"),
        F.col("x.l_extendedprice").alias("gq"),
        (F.col("x.l_returnflag") == "R").alias("phased"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_view(spark, sf_dir, INTERVALS, "part")
