"""Filters on sites. Conditions are Columns; a condition that is null counts as not met."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.genetics import INDEL, SNP
from genoframe.functions.keys import site_key
from genoframe.operators.joins import RANGE, annotate_intervals, unite
from genoframe.operators.ranges import reach_before, running_total, with_previous


def include(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(F.coalesce(condition, F.lit(False)))


def exclude(df: DataFrame, condition: Column) -> DataFrame:
    """Drops what meets the condition; where it is unknown the row stays."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def any_sample(samples: Column, condition) -> Column:
    """Whether any sample meets a condition; unknown counts as not met."""
    return F.exists(samples, lambda s: F.coalesce(condition(s), F.lit(False)))


def minimum(samples: Column, value) -> Column:
    """Least value over samples that have one; positive infinity without any."""
    return F.coalesce(F.array_min(F.transform(samples, lambda s: value(s).cast("double"))), F.lit(float("inf")))


def maximum(samples: Column, value) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda s: value(s).cast("double"))), F.lit(float("-inf")))


def average(samples: Column, value) -> Column:
    """Mean over samples that have a value; null without any."""
    known = F.array_compact(F.transform(samples, lambda s: value(s).cast("double")))
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


def soft_filter(df: DataFrame, condition: Column, name: str, *, append: bool = False, reset: bool = False) -> DataFrame:
    """FILTER (an array, null if unset) gets ``name`` where the condition fails.

    A failing row's filters are replaced, or kept with ``append``. A passing row
    becomes PASS if it has none, or always with ``reset``.
    """
    ok, old = F.coalesce(condition, F.lit(False)), F.col("filters")
    kept = F.coalesce(F.array_remove(old, "PASS"), F.expr("cast(array() as array<string>)"))
    failed = F.array_union(kept, F.array(F.lit(name))) if append else F.array(F.lit(name))
    passed = F.array(F.lit("PASS")) if reset else F.coalesce(old, F.array(F.lit("PASS")))
    return df.withColumn("filters", F.when(ok, passed).otherwise(failed))


@dataclass
class Test:
    """A condition on a site with its mask of samples: ``samples`` is null for a condition on the site alone."""

    __test__ = False  # not a test case
    site: Column
    samples: Column | None = None

    @classmethod
    def of_samples(cls, samples: Column, condition) -> "Test":
        return cls._masked(F.transform(samples, lambda s: F.coalesce(condition(s), F.lit(False))))

    @classmethod
    def _masked(cls, mask: Column) -> "Test":
        return cls(F.exists(mask, lambda x: x), mask)

    def __and__(self, other: "Test") -> "Test":
        """Both: in the same sample where both look at samples; a site's condition holds for each of its samples."""
        if self.samples is None and other.samples is None:
            return Test(self.site & other.site)
        if self.samples is None or other.samples is None:
            whole, part = (self, other) if self.samples is None else (other, self)
            return self._masked(F.transform(part.samples, lambda x: x & whole.site))
        return self._masked(F.zip_with(self.samples, other.samples, lambda a, b: a & b))

    def __or__(self, other: "Test") -> "Test":
        """Either; a condition on the site leaves the mask as the one on samples has it."""
        if self.samples is None or other.samples is None:
            return Test(self.site | other.site, self.samples if self.samples is not None else other.samples)
        return self._masked(F.zip_with(self.samples, other.samples, lambda a, b: a | b))

    def or_all(self, other: "Test") -> "Test":
        """Either; a condition on the site that holds puts all samples into the mask."""
        if (self.samples is None) == (other.samples is None):
            return self | other
        whole, part = (self, other) if self.samples is None else (other, self)
        return self._masked(F.transform(part.samples, lambda x: x | whole.site))


def with_snp_gap(df: DataFrame, gap: int, name: str = "near") -> DataFrame:
    """Adds a flag: a SNP (``is_snp``) within ``gap`` of an indel (``is_indel``) that covers pos to pos + ``span`` - 1.

    Indels, widened by the gap, are united and meet the SNPs by contig and bin.
    """
    by = site_key(df)
    wide = df.filter("is_indel").select(*by[:-1], (F.col("pos") - gap).alias("from1"), (F.col("pos") + F.col("span") - 1 + gap).alias("to1"))
    wide = unite(wide).withColumn(name, F.lit(True))
    out = annotate_intervals(df, wide, start=F.col("pos"), end=F.col("pos"), value=name, order="from1")
    return out.withColumn(name, F.col("is_snp") & F.coalesce(name, F.lit(False)))


def indel_gap(indels: DataFrame, gap: int, *, order: str = "rec", size: int = RANGE) -> DataFrame:
    """Of indels chained by ``gap`` the one with most support (``ac``, then first) stays.

    A chain ends where the next indel begins beyond the end of the one right before.
    """
    reach = with_previous(indels.withColumn("_reach", F.col("pos") + F.col("span") - 1 + gap), "_reach", [F.col("pos"), F.col(order)], size=size)
    fresh = reach.withColumn("_new", F.when(F.col("pos") <= F.col("previous"), 0).otherwise(1)).drop("previous", "_reach")
    chained = running_total(fresh, "_new", "_chain", [F.col("pos"), F.col(order)], size=size)
    best = Window.partitionBy("chrom", "_chain").orderBy(F.desc_nulls_last("ac"), "pos", order)
    return chained.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_new", "_chain", "_rank")


#: The letters of the legacy filter, fixed: passed, mapping quality, depth low and high, ALT bases, gap, lesser gap, bias, lesser neighbour or genotype quality, Hardy-Weinberg.
LETTERS = "UQdDaGgPMS"


def legacy_gates(
    sites: DataFrame, *, min_quality: float = 10, min_depth: int = 2, max_depth: int = 10_000_000, min_alts: int = 2, indel_window: int = 10, snp_window: int = 3,
    bias: tuple[float, ...] = (1e-4, 1e-100, 0, 1e-4), hwe: float = 1e-4, min_genotype_quality: float = 0, max_strand: float = 1000,
) -> DataFrame:
    """Adds ``letter``, one of ``LETTERS``: why the legacy filter drops a site, U if it stays.

    Sites without ALT or with REF N are left out. Of a record alone: d, D depth ``dp``
    too low or high; in its place a, too few ALT bases (the last two of ``dp4``); else Q
    RMS mapping quality ``mq``; else P one of the four bias tests ``pv4``; else M least
    genotype quality ``mxgq`` or strand value ``mxsp``; in place of all, S its
    Hardy-Weinberg chance ``hwe`` below the limit with more heterozygotes than expected
    of ``g3``. Missing values pass.

    Then records meet those read before them (by ``pos``, ``rec``), see :func:`_judge`.
    What is read before matters only as far as it reaches, so each contig falls into
    islands, dealt whole to tasks, which walk them in order and hold only what still
    reaches the current record. Needs ``rec``, ``ref``, ``alts``, ``qual``.
    """
    have = lambda c: F.col(c) if c in sites.columns else F.lit(None)
    met = lambda x: F.coalesce(x, F.lit(False))
    at = lambda c, k: F.get(c, F.lit(k)).cast("double") if c in sites.columns else F.lit(None).cast("double")
    alt_bases = at("dp4", 2) + at("dp4", 3)
    depth = F.when(met(have("dp") < min_depth), "d").when(met(have("dp") > max_depth), "D")
    depth = F.when(met(alt_bases < min_alts), "a").otherwise(depth)
    biased = reduce(lambda x, y: x | y, [met(at("pv4", k) < limit) for k, limit in enumerate(bias)])
    low = met(have("mxgq") < min_genotype_quality) | met(have("mxsp") >= max_strand)
    p = 2 * at("g3", 0) + at("g3", 1)
    excess = met(have("hwe") < hwe) & met((p > 0) & (p < 1) & (at("g3", 1) > p * (1 - p)))
    alone = F.when(excess, "S").otherwise(F.coalesce(depth, F.when(met(have("mq") < min_quality), "Q").when(biased, "P").when(low, "M"), F.lit("U")))
    size = F.length("ref")
    longer = F.exists("alts", lambda a: F.length(a) != size)
    kind = F.when(longer, 3).when(size > 1, 2).otherwise(1)
    rows = sites.filter((F.size("alts") > 0) & (F.col("ref") != "N")).select(
        "chrom", F.col("pos").cast("long").alias("pos"), F.col("rec").cast("long").alias("rec"), "ref", F.array_join("alts", ",").alias("alt"), kind.alias("kind"),
        (F.coalesce(have("qual").cast("double"), F.lit(0.0)) * 100 + F.coalesce(alt_bases, F.lit(-1.0))).alias("score"), alone.alias("letter"),
    )
    order = [F.col("pos"), F.col("rec")]
    window = F.when(F.col("kind") == 3, max(indel_window, snp_window)).otherwise(snp_window)
    reach = reach_before(rows.withColumn("_reach", F.col("pos") + F.length("ref") - 1 + window), "_reach", "_before", order)
    fresh = reach.withColumn("_new", F.when(F.col("pos") <= F.col("_before"), 0).otherwise(1)).drop("_reach", "_before")
    islands = running_total(fresh, "_new", "island", order).drop("_new").repartition("chrom", "island").sortWithinPartitions("chrom", "island", *order)
    kinds = {f.name: f.dataType.simpleString() for f in islands.schema}
    letters = islands.mapInPandas(_walk(indel_window, snp_window), f"chrom {kinds['chrom']}, rec long, letter string")
    return sites.join(letters, ["chrom", "rec"])


class _Site:
    __slots__ = ("chrom", "pos", "rec", "ref", "alt", "kind", "score", "letter", "end")

    def __init__(self, chrom, pos, rec, ref, alt, kind, score, letter) -> None:
        self.chrom, self.pos, self.rec, self.ref, self.alt, self.kind, self.score, self.letter = chrom, pos, rec, ref, alt, kind, score, letter
        self.end = pos + len(ref) - 1


def _judge(site: _Site, before: Iterable[_Site], indel_window: int, snp_window: int) -> None:
    """Letters of a record that is fine by itself and of those read before it.

    An indel takes the SNPs and MNPs that still stand within ``snp_window`` (G), and of the
    standing indels within ``indel_window``, in order, all of lower score (g) until one
    of no lower score takes it. A SNP or MNP goes by the first indel within ``snp_window``, standing
    or not, unless that is one base longer than its REF and ends at the site in its ALT's
    first base: then the indel goes (G). And of the SNPs and MNPs that reach the site, standing or
    not, all of lower score go until one of no lower score takes it (M). A score read
    before counts without its fraction.
    """
    if site.kind == 3:
        for x in before:
            if x.kind != 3 and x.letter == "U" and x.end + snp_window >= site.pos:
                x.letter = "G"
        rivals, mark = [x for x in before if x.kind == 3 and x.letter == "U" and x.end + indel_window >= site.pos], "g"
    else:
        gap = next((x for x in before if x.kind == 3 and x.end + snp_window >= site.pos), None)
        if gap:
            same = len(gap.alt) - len(gap.ref) == 1 and gap.pos + len(gap.alt) - 1 == site.pos and gap.alt[-1] == site.alt[0]
            (gap if same else site).letter = "G"
        rivals, mark = [x for x in before if x.kind != 3 and x.end >= site.pos], "M"
    for x in rivals:
        loser = x if int(x.score) < site.score else site
        loser.letter = mark
        if loser is site:
            break


def _walk(indel_window: int, snp_window: int):
    far = max(indel_window, snp_window)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[_Site] = deque()  # of one island, in order
        island = None
        for b in batches:
            done: list[_Site] = []
            for chrom, pos, rec, ref, alt, kind, score, letter, own in b[["chrom", "pos", "rec", "ref", "alt", "kind", "score", "letter", "island"]].itertuples(index=False):
                if (chrom, own) != island:
                    done += held
                    held.clear()
                    island = (chrom, own)
                while held and held[0].end + far < pos:
                    done.append(held.popleft())
                site = _Site(chrom, pos, rec, ref, alt, kind, score, letter)
                if letter == "U":
                    _judge(site, held, indel_window, snp_window)
                held.append(site)
            yield _letters(done, b)
        if island is not None:
            yield _letters(list(held), b)

    return walk


def _letters(done: list[_Site], like: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chrom": pd.Series([s.chrom for s in done], dtype=like["chrom"].dtype), "rec": [s.rec for s in done], "letter": [s.letter for s in done]})


def caller_gate(sites: DataFrame, *, variants_only: bool = False, skip: str | None = None, keep_n: bool = False) -> DataFrame:
    """Sites that a caller looks at: not those whose REF is N, with ``variants_only`` none without ALT, without ``skip`` (``snps`` or ``indels``)."""
    out = sites if keep_n else sites.filter(~F.upper("ref").startswith("N"))
    if variants_only:
        out = out.filter(F.size("alts") > 0)
    if skip:
        out = out.filter(F.col("mask").bitwiseAND({"snps": SNP, "indels": INDEL}[skip]) == 0)
    return out


def biallelic(sites: DataFrame, *, snps_only: bool = True) -> DataFrame:
    """Sites with one ALT, SNPs unless told otherwise: what runs of homozygosity are read from."""
    out = sites.filter(F.size("alts") == 1)
    return out.filter(F.col("mask") == SNP) if snps_only else out


def private(samples: Column, subset: list[int]) -> Column:
    """Non-reference alleles occur, and only in the samples of the subset."""
    carriers = F.filter(samples, lambda s: (s["a"] > 0) | (s["b"] > 0))
    return (F.size(carriers) > 0) & F.forall(carriers, lambda s: s["sample"].isin(subset))


def first_gate(gates: list[tuple[str, Column]], passed: str = "-") -> Column:
    """The letter of the first gate whose condition a site meets, in the order given; ``passed`` if it meets none."""
    return F.coalesce(*[F.when(condition, letter) for letter, condition in gates], F.lit(passed))


def all_phased(samples: Column) -> Column:
    """Every sample's genotype is phased or haploid."""
    return F.forall(samples, lambda s: F.coalesce(s["phased"] | (s["a"].isNotNull() & s["b"].isNull()), F.lit(False)))
