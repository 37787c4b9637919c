"""Order along a contig without one task for a contig.

Rows are dealt by (keys, range of positions). What crosses a range is one summary row
of it; summary rows are put in order in a window of their own, whose size follows the
length of a contig in ranges and not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1 << 20


def _ranged(rows: DataFrame, keys: list[str], pos: str, size: int) -> DataFrame:
    return rows.withColumn("_range", F.floor(F.col(pos) / size)).repartition(*keys, "_range")


def with_previous(rows: DataFrame, value: str, order: list[Column], *, keys: list[str] = ["chrom"], pos: str = "pos", size: int = RANGE, name: str = "previous") -> DataFrame:  # noqa: B006
    """Adds ``value`` of the row before by ``order``, which begins with ``pos``; null for the first of its keys."""
    cut = _ranged(rows, keys, pos, size)
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    last = cut.groupBy(*keys, "_range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carry = last.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    own = F.lag(F.struct(value)).over(w)
    return cut.join(carry, [*keys, "_range"]).withColumn(name, F.coalesce(own, "_carry")[value]).drop("_range", "_carry")


def running_total(rows: DataFrame, value: str, name: str, order: list[Column], *, keys: list[str] = ["chrom"], pos: str = "pos", size: int = RANGE) -> DataFrame:  # noqa: B006
    """Adds the sum of ``value`` up to and with the row, by ``order``, which begins with ``pos``."""
    cut = _ranged(rows, keys, pos, size)
    sums = cut.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_carry"))
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(carry, [*keys, "_range"]).withColumn(name, F.col("_carry") + F.sum(value).over(w)).drop("_range", "_carry")


def reach_before(rows: DataFrame, value: str, name: str, order: list[Column], *, keys: list[str] = ["chrom"], pos: str = "pos", size: int = RANGE) -> DataFrame:  # noqa: B006
    """Adds the largest ``value`` of all rows before by ``order``, which begins with ``pos``; null for the first of its keys."""
    cut = _ranged(rows, keys, pos, size)
    tops = cut.groupBy(*keys, "_range").agg(F.max(value).alias("_top"))
    above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_range", F.max("_top").over(above).alias("_carry"))
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(carry, [*keys, "_range"]).withColumn(name, F.greatest(F.max(value).over(w), "_carry")).drop("_range", "_carry")


def with_neighbours(rows: DataFrame, value: Column, *, keys: list[str] = ["chrom"], pos: str = "pos", size: int = RANGE) -> DataFrame:  # noqa: B006
    """Adds ``before`` and ``after``: the nearest values that are not null at or before and at or after the row's position."""
    cut = _ranged(rows.withColumn("_v", value), keys, pos, size)
    w = Window.partitionBy(*keys, "_range").orderBy(pos)
    place = F.when(F.col("_v").isNotNull(), F.col(pos))
    ends = cut.groupBy(*keys, "_range").agg(F.max_by("_v", place).alias("_hi"), F.min_by("_v", place).alias("_lo"))
    every = Window.partitionBy(*keys).orderBy("_range")
    left = F.last("_hi", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    turned = Window.partitionBy(*keys).orderBy(F.desc("_range"))  # a frame that is open ahead would be gone through again for each row
    right = F.last("_lo", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*keys, "_range", left.alias("_left"), right.alias("_right"))
    before = F.last("_v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys, "_range").orderBy(F.desc(pos))
    after = F.last("_v", ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0))
    out = cut.join(carry, [*keys, "_range"]).withColumns({"before": F.coalesce(before, "_left"), "after": F.coalesce(after, "_right")})
    return out.drop("_range", "_v", "_left", "_right")


def order_breaks(rows: DataFrame, *, order: str = "rec", size: int = RANGE) -> DataFrame:
    """Rows (by ``order``, the order in the file) that come after a later position of their contig, or after their contig ended: empty if sorted.

    Rows are dealt by range of ``order``; of each range only its last row is carried on.
    """
    one = rows.withColumn("_all", F.lit(0))
    prior = with_previous(one.withColumn("_at", F.struct("chrom", "pos")), "_at", [F.col(order)], keys=["_all"], pos=order, size=size, name="_prior")
    fresh = prior.withColumn("_switch", F.when(F.col("_prior").isNull() | (F.col("_prior.chrom") != F.col("chrom")), 1).otherwise(0))
    blocks = fresh.filter("_switch = 1").groupBy("chrom").agg(F.min(order).alias("_begins"), F.count("*").alias("_blocks"))
    back = (F.col("_switch") == 0) & (F.col("pos") < F.col("_prior.pos"))
    again = (F.col("_switch") == 1) & (F.col("_blocks") > 1) & (F.col(order) > F.col("_begins"))
    out = fresh.join(blocks, "chrom").filter(back | again)
    return out.drop("_all", "_at", "_prior", "_switch", "_begins", "_blocks")
