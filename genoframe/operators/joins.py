"""Joins by site, allele and interval. Every key has the contig in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.genetics import trim_suffix
from genoframe.functions.keys import site_key

#: Positions to a bin of interval joins, and to a range in which regions are united.
BIN, RANGE = 1024, 1 << 20


# --- matching of records -----------------------------------------------------


def match_key(mode: str, ref: str = "ref", alts: str = "alts", mask: str = "mask") -> Column:
    """What must agree, besides the site, for records of several files to be one.

    ``none``: same REF and ALTs; ``snps``, ``indels``, ``both``: same class of those
    suffices; ``all``: the site alone. For ``some`` see :func:`with_match_key`.
    """
    exact = F.concat(F.col(ref), F.lit(">"), F.array_join(F.array_sort(alts), ","))
    if mode == "all":
        return F.lit("")
    classes = {"snps": 1, "indels": 2, "both": 3, "none": 0}[mode]
    own = F.col(mask).bitwiseAND(F.lit(classes))
    return F.when(own != 0, own.cast("string")).otherwise(exact)


def with_match_key(rows: DataFrame, mode: str) -> DataFrame:
    """Adds ``key``. ``some``: same REF and a chain of records that share an ALT.

    The classes of ``some`` are found inside a site, whose records are few.
    """
    if mode != "some":
        return rows.withColumn("key", match_key(mode))
    by = site_key(rows)
    shares = lambda c, x: (c["ref"] == x["ref"]) & F.arrays_overlap(c["alts"], x["alts"])

    def add(classes: Column, x: Column) -> Column:
        met = F.transform(F.filter(classes, lambda c: shares(c, x)), lambda c: c["alts"])
        whole = F.array_distinct(F.flatten(F.concat(F.array(x["alts"]), met)))
        return F.concat(F.filter(classes, lambda c: ~shares(c, x)), F.array(F.struct(x["ref"].alias("ref"), whole.alias("alts"))))

    none = F.expr("cast(array() as array<struct<ref:string,alts:array<string>>>)")
    found = rows.groupBy(*by).agg(F.aggregate(F.collect_set(F.struct("ref", "alts")), none, add).alias("_classes"))
    own = F.get(F.filter("_classes", lambda c: shares(c, {"ref": F.col("ref"), "alts": F.col("alts")})), F.lit(0))["alts"]
    key = F.concat(F.col("ref"), F.lit(">"), F.array_join(F.array_sort(F.coalesce(own, F.col("alts"))), ","))
    return rows.join(found, by).withColumn("key", key).drop("_classes")


def presence(files: list[DataFrame], mode: str = "none") -> DataFrame:
    """(chrom, pos, key, nth, present, first): one row for each matched record.

    ``present`` has a 1 or 0 for each file; ``first`` is the record of the first file
    that has it. The n-th record of a key in one file matches the n-th in another. Rows
    are dealt out by site once, which the numbering and the grouping share.
    """
    by = site_key(*files)
    rows = reduce(DataFrame.unionByName, [f.withColumn("file", F.lit(k)) for k, f in enumerate(files)]).repartition(*by)
    rows = with_match_key(rows, mode)
    nth = F.row_number().over(Window.partitionBy(*by, "key", "file").orderBy("ref", F.array_join("alts", ","), "qual"))
    rows = rows.withColumn("nth", nth)
    carried = [c for c in files[0].columns if c not in by]
    present = F.concat(*[F.max((F.col("file") == k).cast("int")).cast("string") for k in range(len(files))])
    return rows.groupBy(*by, "key", "nth").agg(present.alias("present"), F.min_by(F.struct(*carried), "file").alias("first"))


def intersect(files: list[DataFrame], n: int, compare: str = "=", mode: str = "none") -> DataFrame:
    """Records in exactly (``=``), at least (``+``) or at most (``-``) ``n`` files."""
    count = F.length(F.replace("present", F.lit("0"), F.lit("")))
    test = {"=": count == n, "+": count >= n, "-": count <= n}[compare]
    return presence(files, mode).filter(test)


def apply_filters(rows: DataFrame, names: list[str], column: str = "filters") -> DataFrame:
    """Records with one of the FILTERs named; ``.`` stands for none set. Put it before a join of files."""
    listed = F.arrays_overlap(column, F.array(*[F.lit(n) for n in names]))
    return rows.filter(F.coalesce(listed, F.lit(False)) | (F.lit("." in names) & F.col(column).isNull()))


def mark_known(rows: DataFrame, positions: DataFrame, name: str = "known") -> DataFrame:
    """Adds a flag: the site is one of ``positions``."""
    by = site_key(rows, positions)
    return rows.join(positions.select(*by).distinct().withColumn(name, F.lit(True)), by, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# --- intervals -----------------------------------------------------------------


def _bin(p: Column, size: int) -> Column:
    return F.floor(p / size)


def _bins(begin: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(_bin(begin, size), _bin(end, size)))


def unite(regions: DataFrame) -> DataFrame:
    """Regions with overlapping ones united, within ranges of RANGE positions of a contig at a time."""
    by = [c for c in ("chrom",) if c in regions.columns]
    cut = regions.withColumn("_range", _bins(F.col("from1"), F.col("to1"), RANGE))
    cut = cut.select(*by, "_range", F.greatest("from1", F.col("_range") * RANGE).alias("from1"), F.least("to1", (F.col("_range") + 1) * RANGE - 1).alias("to1"))
    w = Window.partitionBy(*by, "_range").orderBy("from1", "to1")
    reach = F.max("to1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = cut.withColumn("_new", F.when(F.col("from1") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return island.groupBy(*by, "_range", "_island").agg(F.min("from1").alias("from1"), F.max("to1").alias("to1")).select(*by, "from1", "to1")


def _hits(spans: DataFrame, regions: DataFrame, bin_size: int) -> DataFrame:
    """Distinct spans (``_start``, ``_end``) joined with the regions that they overlap, by contig and bin."""
    by = site_key(spans.withColumn("pos", F.lit(0)), regions.withColumn("pos", F.lit(0)))[:-1]
    spans = spans.select(*by, "_start", "_end").distinct()
    binned = spans.withColumn("_bin", _bins(F.col("_start"), F.col("_end"), bin_size))
    cut = regions.withColumn("_bin", _bins(F.col("from1"), F.col("to1"), bin_size))
    return binned.join(cut, [*by, "_bin"]).filter((F.col("_start") <= F.col("to1")) & (F.col("_end") >= F.col("from1")))


def select_regions(rows: DataFrame, regions: DataFrame, *, start: Column, end: Column, bin_size: int = BIN) -> DataFrame:
    """Rows whose span (1-based, inclusive) overlaps any region (``chrom``, ``from1``, ``to1``), as often as they come.

    Both sides are cut into bins of ``bin_size`` positions, so the join is an equi-join
    on contig and bin. Whether a span is chosen depends on the span alone: distinct
    spans meet the united regions, and rows are kept by a semi-join.
    """
    by = [c for c in ("chrom",) if c in rows.columns]
    spans = rows.withColumns({"_start": start, "_end": end})
    chosen = _hits(spans, unite(regions), bin_size).select(*by, "_start", "_end").distinct()
    return spans.join(chosen, [*by, "_start", "_end"], "left_semi").select(*rows.columns)


def annotate_intervals(rows: DataFrame, regions: DataFrame, *, start: Column, end: Column, value: str, order: str, bin_size: int = BIN) -> DataFrame:
    """Adds ``value`` of the first region (by ``order``) that overlaps the row's span; null without one."""
    by = [c for c in ("chrom",) if c in rows.columns]
    spans = rows.withColumns({"_start": start, "_end": end})
    first = _hits(spans, regions.select(*[c for c in ("chrom",) if c in regions.columns], "from1", "to1", value, order), bin_size)
    first = first.groupBy(*by, "_start", "_end").agg(F.min_by(value, order).alias(value))
    return spans.join(first, [*by, "_start", "_end"], "left").select(*rows.columns, value)


# --- alleles -------------------------------------------------------------------


def annotate_alleles(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Adds columns of a table keyed by site, ``ref`` and ``alt``: those of the first ALT of the row that matches.

    Both sides are brought to their shortest form (endings that REF and ALT share are
    taken off), so a longer REF matches a shorter one that says the same.
    """
    by = site_key(rows, table)
    short = lambda df, ref, alt: df.withColumn("_t", trim_suffix(F.array(ref, alt))).withColumns({"_r": F.get("_t", F.lit(0)), "_a": F.get("_t", F.lit(1))}).drop("_t")
    long = short(rows.select(*by, "ref", "alts", F.posexplode("alts").alias("_k", "_alt")), "ref", "_alt")
    side = short(table.select(*by, "ref", "alt", *columns), "ref", "alt").select(*by, "_r", "_a", *columns)
    first = long.join(side, [*by, "_r", "_a"]).groupBy(*by, "ref", "alts").agg(F.min_by(F.struct(*columns), "_k").alias("_v"))
    return rows.join(first, [*by, "ref", "alts"], "left").select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in columns])


def allele_frequencies(rows: DataFrame, source: DataFrame, column: str = "af") -> DataFrame:
    """Adds ``column`` of a source whose record has exactly the same alleles; records without one are left out."""
    by = site_key(rows, source)
    return rows.join(source.select(*by, "ref", "alts", column), [*by, "ref", "alts"])
