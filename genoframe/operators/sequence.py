"""Operators along a chromosome: islands, phase ligation, maps, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.shared import written
from genoframe.operators.ranges import RANGE, running_total, with_neighbours, with_previous


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column, *, size: int = RANGE) -> DataFrame:
    """Runs of consecutive rows with ``flag``: (keys, first, last, n). ``order`` is a number without ties inside the keys."""
    marked = with_previous(rows.withColumn("_f", F.coalesce(flag, F.lit(False))), "_f", [F.col(order)], keys=keys, pos=order, size=size)
    marked = marked.withColumn("_new", (F.col("_f") & ~F.coalesce("previous", F.lit(False))).cast("int"))
    numbered = running_total(marked.select(*keys, order, "_f", "_new"), "_new", "_run", [F.col(order)], keys=keys, pos=order, size=size).filter("_f")
    return numbered.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


#: Fixed values of the quality of a join: its largest, and what shifts and scales it.
_BEST_QUALITY, _SHIFT = 99, 0.7


def _file_ends(chunks: DataFrame) -> DataFrame:
    """(chrom, chunk, k, lo, hi, start, prior_hi, next_lo, next_hi): a row for each file of a contig, numbered in order."""
    w = Window.partitionBy("chrom").orderBy("chunk")
    ends = chunks.groupBy("chrom", "chunk").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    ends = written(ends, "file-ends").withColumns({"k": F.row_number().over(w), "start": F.min("lo").over(Window.partitionBy("chrom")), "prior_hi": F.lag("hi").over(w), "next_lo": F.lead("lo").over(w), "next_hi": F.lead("hi").over(w), "_third": F.lead("lo", 2).over(w)})
    if not ends.filter("_third <= hi").isEmpty():
        raise ValueError("more than two files overlap")
    return written(ends.drop("_third"), "file-ends")


def _in_overlaps(rows: DataFrame) -> DataFrame:
    """Rows with :func:`_file_ends`, once for each overlap they are in: ``join`` is the first file's number, ``side`` 0 in it and 1 in the next."""
    after, before = F.col("pos").between(F.col("next_lo"), F.col("next_hi")), F.col("pos") <= F.col("prior_hi")
    met = F.array(F.when(after, F.struct(F.col("k").alias("join"), F.lit(0).alias("side"))), F.when(before, F.struct((F.col("k") - 1).alias("join"), F.lit(1).alias("side"))))
    return rows.withColumn("_met", F.explode(F.array_compact(met))).select("*", "_met.*").drop("_met")


def _paired_sites(placed: DataFrame) -> DataFrame:
    """(chrom, join, pos, nth, n) for sites that both files of an overlap have, numbered by range along it."""
    both = _in_overlaps(placed).groupBy("chrom", "join", "pos").agg(F.count("*").alias("_n")).filter("_n = 2").withColumn("_one", F.lit(1)).drop("_n")
    nth = written(running_total(both, "_one", "nth", [F.col("pos")], keys=["chrom", "join"]).drop("_one"), "paired")
    return nth.join(nth.groupBy("chrom", "join").agg(F.max("nth").alias("n")), ["chrom", "join"])


def ligate_phase(chunks: DataFrame, *, min_quality: int = 30) -> DataFrame:
    """How the files of a phased set join: (sample, chrom, chunk, matches, mismatches, swapped, quality, phase_set).

    Rows: ``sample``, ``chrom``, ``chunk`` (the file, in order), ``pos``, ``a``, ``b``,
    ``phased``; samples of a file have the same sites. At sites of an overlap that both
    files have, samples that are heterozygous and phased in both vote. By the majority
    a file keeps or turns the state of the one before; a draw leaves it unswapped, and
    where no site is in both files the state stays. ``quality`` is null in the first file
    and where there is no such site; below ``min_quality`` the second half of the overlap,
    if it has a site, begins a new phase set; the first one begins at the contig's first site.
    Rows are worked out once and written to the shared folder, from where all passes read.
    """
    chunks = written(chunks, "phased")
    ends = _file_ends(chunks)
    paired = _paired_sites(chunks.select("chrom", "chunk", "pos").distinct().join(ends, ["chrom", "chunk"]))
    return _joined_files(chunks, ends, paired, min_quality).drop("k", "second")


def _joined_files(chunks: DataFrame, ends: DataFrame, paired: DataFrame, min_quality: int) -> DataFrame:
    by = ["sample", "chrom"]
    het = chunks.filter("a != b and phased").select(*by, "chunk", "pos", "a", "b").join(ends, ["chrom", "chunk"])
    own = lambda side: F.max(F.when(F.col("side") == side, F.struct("a", "b")))
    two = _in_overlaps(het).groupBy(*by, "join", "pos").agg(own(0).alias("x"), own(1).alias("y"))
    same, turned = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))
    votes = two.groupBy(*by, "join").agg(F.count_if(same).alias("matches"), F.count_if(turned).alias("mismatches"))
    second = paired.groupBy("chrom", "join").agg(F.min(F.when(F.col("nth") > F.ceil(F.col("n") / 2), F.col("pos"))).alias("second"), F.max("n").alias("n"))
    at = {"join": F.col("join") + 1}
    files = chunks.select(*by, "chunk").distinct().join(ends.select("chrom", "chunk", "k", "start"), ["chrom", "chunk"])
    rows = files.join(second.withColumns(at).withColumnRenamed("join", "k"), ["chrom", "k"], "left")
    rows = rows.join(votes.withColumns(at).withColumnRenamed("join", "k"), [*by, "k"], "left").fillna(0, ["matches", "mismatches", "n"])
    w = Window.partitionBy(*by).orderBy("k")  # a row for each file
    drawn = (F.col("n") > 0) & (F.col("matches") == F.col("mismatches"))
    rows = rows.withColumn("_since", F.sum(drawn.cast("int")).over(w))
    turns = F.sum((F.col("mismatches") > F.col("matches")).cast("int")).over(Window.partitionBy(*by, "_since").orderBy("k"))
    f = F.col("matches") / (F.col("matches") + F.col("mismatches"))
    mixed = (F.col("matches") > 0) & (F.col("mismatches") > 0)
    quality = F.when(mixed, (_BEST_QUALITY * (_SHIFT + f * F.log(f) + (1 - f) * F.log(1 - f)) / _SHIFT).cast("int")).otherwise(_BEST_QUALITY)
    rows = rows.withColumns({"swapped": turns % 2 == 1, "quality": F.when((F.col("k") > 1) & (F.col("n") > 0), quality)})
    begins = F.when(F.col("quality") < min_quality, F.col("second"))
    rows = rows.withColumn("phase_set", F.coalesce(F.last(begins, ignorenulls=True).over(w), "start"))
    return rows.select(*by, "chunk", "k", "matches", "mismatches", "swapped", "quality", "phase_set", "second")


def ligated_rows(chunks: DataFrame, *, min_quality: int = 30) -> DataFrame:
    """(sample, chrom, pos, a, b, phased, phase_set, quality) of all files as one phased call set, each site once; see :func:`ligate_phase`.

    The first half of the sites that an overlap's files share is the earlier file's, the
    rest the later one's; sites of an overlap that one file lacks go. Alleles are
    exchanged, and phased, where the file is swapped. ``quality`` is given at the first
    site that the later file gives of an overlap, null elsewhere.
    """
    chunks = written(chunks, "phased")
    ends = _file_ends(chunks)
    placed = written(chunks.select("chrom", "chunk", "pos").distinct().join(ends, ["chrom", "chunk"]), "placed")
    paired = _paired_sites(placed)
    files = _joined_files(chunks, ends, paired, min_quality)
    met = F.col("pos").between(F.col("next_lo"), F.col("next_hi")) | (F.col("pos") <= F.col("prior_hi"))
    apart = placed.filter(~F.coalesce(met, F.lit(False)))
    first = F.col("nth") <= F.ceil(F.col("n") / 2)
    shared = paired.select("chrom", "pos", F.when(first, F.col("join")).otherwise(F.col("join") + 1).alias("k"))
    kept = apart.select("chrom", "pos", "k").unionByName(shared).join(ends.select("chrom", "k", "chunk"), ["chrom", "k"]).select("chrom", "chunk", "pos")
    rows = chunks.join(kept, ["chrom", "chunk", "pos"]).join(files, ["sample", "chrom", "chunk"])
    swap = lambda x, y: F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x))
    phased = F.col("phased") | (F.col("swapped") & F.col("a").isNotNull())
    return rows.select("sample", "chrom", "pos", swap("a", "b").alias("a"), swap("b", "a").alias("b"), phased.alias("phased"), "phase_set", F.when(F.col("pos") == F.col("second"), F.col("quality")).alias("quality"))


def map_position(sites: DataFrame, genetic_map: DataFrame, *, size: int = RANGE) -> DataFrame:
    """Adds ``cm``: linear between the map points around ``pos``, held at the ends.

    Points and sites are put in one order by range of a contig; the nearest points
    outside a range come as its neighbours' ends.
    """
    both = sites.select("chrom", "pos", F.lit(None).cast("double").alias("at")).unionByName(
        genetic_map.select("chrom", "pos", F.col("cm").cast("double").alias("at"))
    )
    near = with_neighbours(both, F.when(F.col("at").isNotNull(), F.struct("pos", "at")), size=size).filter("at is null")
    near = near.withColumnsRenamed({"before": "x", "after": "y"})
    share = (F.col("pos") - F.col("x.pos")) / F.nullif(F.col("y.pos") - F.col("x.pos"), F.lit(0))
    cm = F.when(F.col("x").isNull(), F.col("y.at")).when(F.col("y").isNull(), F.col("x.at"))
    return near.select("chrom", "pos", cm.otherwise(F.col("x.at") + F.coalesce(share, F.lit(0.0)) * (F.col("y.at") - F.col("x.at"))).alias("cm"))


def tiles(lengths: DataFrame, size: int) -> DataFrame:
    """(chrom, length) -> tiles of ``size``; the last takes a rest of less than a tenth."""
    n = F.greatest(F.lit(1), F.floor((F.col("length") / size) + 0.9).cast("int"))
    long = lengths.withColumn("n", n).select("chrom", "length", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return long.select("chrom", (F.col("k") * size + 1).alias("from1"), F.when(F.col("k") == F.col("n") - 1, F.col("length")).otherwise((F.col("k") + 1) * size).alias("to1"))
