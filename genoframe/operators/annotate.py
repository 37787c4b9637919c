"""Edits of annotations: what to remove, and whether an indel shifts the frame of an exon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from genoframe.operators.joins import annotate_intervals


def drop_annotations(sites: DataFrame, names: list[str]) -> DataFrame:
    """Removes ``ID``, ``QUAL``, ``FILTER[/x]``, ``INFO[/x]`` and ``FORMAT[/x]`` from sites.

    ``ID`` and ``QUAL`` become null; ``FILTER`` becomes unset, also when its last name
    goes. ``INFO`` alone drops the column; ``FORMAT`` alone keeps the genotype. Columns
    and fields that are not there are passed over.
    """
    for name in names:
        part, _, one = name.partition("/")
        column = {"ID": "id", "QUAL": "qual", "FILTER": "filters", "INFO": "info", "FORMAT": "samples"}[part]
        if column not in sites.columns:
            continue
        kind, old = sites.schema[column].dataType, F.col(column)
        if part == "FORMAT":
            sites = sites.withColumn(column, _without_tag(old, kind, one))
        elif part == "INFO" and one:
            left = [f for f in kind.names if f != one]
            sites = sites.withColumn(column, F.struct(*[old[f].alias(f) for f in left])) if left else sites.drop(column)
        elif part == "INFO":
            sites = sites.drop(column)
        elif part == "FILTER" and one:
            kept = F.array_remove(old, one)
            sites = sites.withColumn(column, F.when(F.size(kept) > 0, kept))
        else:
            sites = sites.withColumn(column, F.lit(None).cast(kind))
    return sites


def _without_tag(samples: Column, kind: ArrayType, tag: str) -> Column:
    """Samples (maps or structs) without a tag; without any but the genotype if no tag is named."""
    genotype = {"GT", "sample", "a", "b", "phased"}
    if isinstance(kind.elementType, MapType):
        keep = (lambda k, _: k != tag) if tag else (lambda k, _: k == "GT")
        return F.transform(samples, lambda s: F.map_filter(s, keep))
    fields = [f for f in kind.elementType.names if (f != tag if tag else f in genotype)]
    return F.transform(samples, lambda s: F.struct(*[s[f].alias(f) for f in fields]))


def out_of_frame(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """Adds ``oof``: 1 if an indel in an exon has a length that three does not divide, 0 if it has, -1 elsewhere.

    ``exons``: (chrom, from1, to1, name); a deletion counts with its whole span.
    """
    change = F.transform("alts", lambda a: F.abs(F.length(a) - F.length("ref")))
    rows = sites.withColumn("_change", F.filter(change, lambda n: n > 0))
    hit = annotate_intervals(rows, exons.withColumn("_exon", F.lit(True)), start=F.col("pos"), end=F.col("pos") + F.length("ref") - 1, value="_exon", order="name")
    shifted = F.exists("_change", lambda n: n % 3 != 0).cast("int")
    return hit.withColumn("oof", F.when(F.col("_exon") & (F.size("_change") > 0), shifted).otherwise(-1)).drop("_change", "_exon")


def frameshifts(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """One row (in_frame, out_of_frame, not_applicable, share): indel ALTs by the part of them inside an exon.

    Of a deletion only the bases that the exon has count; ``share`` is that of the ALTs out
    of frame among those in an exon, null without any. Of several exons the first by name.
    """
    long = sites.select(*[c for c in ("chrom", "pos", "ref") if c in sites.columns], F.explode("alts").alias("alt")).filter(F.length("ref") != F.length("alt"))
    end = F.col("pos") + F.greatest(F.length("ref") - F.length("alt"), F.lit(0))
    hit = annotate_intervals(long, exons.withColumn("_exon", F.struct("from1", "to1")), start=F.col("pos"), end=end, value="_exon", order="name")
    lost = F.least(end, F.col("_exon.to1")) - F.greatest(F.col("pos") + 1, F.col("_exon.from1")) + 1
    n = F.when(F.length("alt") > F.length("ref"), F.length("alt") - F.length("ref")).otherwise(lost)
    inside = F.col("_exon").isNotNull() & (n > 0)
    out = hit.agg(F.count_if(inside & (n % 3 == 0)).alias("in_frame"), F.count_if(inside & (n % 3 != 0)).alias("out_of_frame"), F.count_if(~inside).alias("not_applicable"))
    return out.withColumn("share", F.col("out_of_frame") / F.nullif(F.col("in_frame") + F.col("out_of_frame"), F.lit(0)))
