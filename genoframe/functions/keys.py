"""What identifies a site."""

from __future__ import annotations

from pyspark.sql import DataFrame


def site_key(*frames: DataFrame) -> list[str]:
    """The columns that name a site in all frames: contig and position.

    Frames of one contig may leave ``chrom`` out, but then all of them must: a position
    alone says nothing where contigs share it.
    """
    named = {"chrom" in f.columns for f in frames}
    if len(named) > 1:
        raise ValueError("chrom is in some of the tables only")
    return ["chrom", "pos"] if named == {True} else ["pos"]
