"""Runs of homozygosity: emissions from likelihoods or genotypes, frequencies of several sources, a two-state chain over a genetic map."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genetics import genotype_index, let
from genoframe.operators.ranges import RANGE, with_neighbours

#: Positions of a chromosome handled together.
CHUNK = 1_000_000
#: Chances of a crossing-over for each base without a map, and of turning to and from autozygosity at one.
PER_BASE, TO_AZ, TO_HW = 1e-8, 1e-4, 1e-3


# --- frequencies and emissions -------------------------------------------------


def frequencies_of_tag(af: Column, n_alts: Column) -> Column:
    """Frequencies of all alleles, REF first, from those of the ALTs; null where their number is another."""
    total = F.aggregate(af, F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(af) == n_alts, F.concat(F.array(1 - total), af))


def frequencies_of_counts(an: Column, ac: Column) -> Column:
    """The same from the number of called alleles and the counts of the ALTs; null without called ones."""
    rest = an - F.aggregate(ac, F.lit(0).cast("long"), lambda t, x: t + x)
    return F.when(an > 0, F.transform(F.concat(F.array(rest), ac.cast("array<bigint>")), lambda x: x / an))


def frequencies_of_genotypes(codes: Column, n_alts: Column) -> Column:
    """The same from the allele numbers of samples."""
    called = F.array_compact(codes)
    return F.when(F.size(called) > 0, F.transform(F.sequence(F.lit(0), n_alts), lambda k: F.size(F.filter(called, lambda a: a == k)) / F.size(called)))


def _emitted(rr: Column, ra: Column, aa: Column, r: Column, a: Column) -> tuple[Column, Column]:
    return rr * r * r + 2 * ra * r * a + aa * a * a, rr * r + aa * a


def likelihood_emissions(pl: Column, af: Column) -> Column:
    """Struct (p_hw, p_az) of a sample from its diploid likelihoods and the frequencies of all alleles; null where it says nothing.

    The alleles compared are those of the likeliest genotype: two different ones, REF and
    the ALT that it has twice, or REF and the first ALT where it is REF twice.
    Likelihoods that are 0 but for the first, have gaps, or another number than the
    alleles ask for, say nothing.
    """
    n = F.size(af)

    def emitted(p: Column, j: Column, k: Column) -> Column:
        chance = lambda a, b: F.get(p, genotype_index(a, b))
        total = F.aggregate(p, F.lit(0.0), lambda t, x: t + x)
        hw, az = _emitted(chance(j, j), chance(j, k), chance(k, k), F.get(af, j), F.get(af, k))
        return F.struct((hw / total).alias("p_hw"), (az / total).alias("p_az"))

    def pair(p: Column) -> Column:
        best = F.array_position(pl, F.array_min(pl)).cast("int") - 1

        def compared(g: Column) -> Column:
            k = F.floor((F.sqrt(8 * g + 1) - 1) / 2).cast("int")
            j = (g - k * (k + 1) / 2).cast("int")
            low, high = F.when(j == k, F.lit(0)).otherwise(j), F.when(k == 0, F.lit(1)).otherwise(k)
            return let(F.struct(low.alias("j"), high.alias("k")), lambda x: emitted(p, x["j"], x["k"]))

        return F.when(n == 2, emitted(p, F.lit(0), F.lit(1))).otherwise(let(best, compared))

    told = (F.size(pl) == n * (n + 1) / 2) & F.forall(pl, lambda x: x.isNotNull()) & F.exists(F.slice(pl, 2, F.size(pl)), lambda x: x != 0) & (n > 1)
    return F.when(told, let(F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10)), pair))


def genotype_emissions(a: Column, b: Column, af: Column, unseen: float = 30.0) -> Column:
    """The same from a called genotype, whose other genotypes have likelihoods of ``unseen`` (phred); null where an allele is missing."""
    e = F.lit(10 ** (-unseen / 10))
    seen = 1 - 2 * e
    low = F.when(a != b, F.least(a, b)).otherwise(F.lit(0))
    high = F.when(a != b, F.greatest(a, b)).when(a == 0, F.lit(1)).otherwise(a)
    rr, ra, aa = F.when((a == b) & (a == 0), seen).otherwise(e), F.when(a != b, seen).otherwise(e), F.when((a == b) & (a != 0), seen).otherwise(e)
    hw, az = _emitted(rr, ra, aa, F.get(af, low), F.get(af, high))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(af) > 1), F.struct(hw.alias("p_hw"), az.alias("p_az")))


# --- the map -------------------------------------------------------------------


def with_map_points(rows: DataFrame, genetic_map: DataFrame, *, size: int = RANGE) -> DataFrame:
    """Adds ``map``: the positions and scaled rates of the map points at or before and at or after the row, at the ends the last there is.

    ``genetic_map``: (chrom, pos, cm); rates are scaled to 1 at a contig's end. Rows of
    contigs without points are left out. Points are looked up once for each site.
    """
    ends = genetic_map.groupBy("chrom").agg(*[f(F.struct("pos", "cm"), "pos").alias(c) for f, c in ((F.min_by, "_lo"), (F.max_by, "_hi"))])
    sites = rows.select("chrom", "pos").distinct()
    both = sites.select("chrom", "pos", F.lit(None).cast("double").alias("cm")).unionByName(genetic_map.select("chrom", "pos", F.col("cm").cast("double").alias("cm")))
    near = with_neighbours(both, F.when(F.col("cm").isNotNull(), F.struct("pos", "cm")), size=size).filter("cm is null").join(ends, "chrom")
    lo, hi = F.coalesce("before", "_lo"), F.coalesce("after", "_hi")
    scaled = lambda p: p["cm"] / F.col("_hi.cm")
    point = F.array(*[c.cast("double") for c in (lo["pos"], scaled(lo), hi["pos"], scaled(hi))])
    return rows.join(near.select("chrom", "pos", point.alias("map")), ["chrom", "pos"])


def _crossing(before: np.ndarray, after: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chances of a crossing-over from ``start`` to ``end``, by the points (their ``map``) around the two; without a map by bases."""
    if before is None:
        return (end - start + 1.0) * PER_BASE
    x, y = before[:, 0], after[:, 2]
    width = np.where(y > x, y - x, 1.0)
    rate = (after[:, 3] - before[:, 1]) / width * (np.minimum(end, y) - np.maximum(start, x))
    return np.where(y > x, np.clip(rate, 0.0, 1.0), 0.0)


# --- the chain -----------------------------------------------------------------
#
# States: 0 not autozygous, 1 autozygous. All in logs; ``plus`` is logaddexp for sums
# over ways and maximum for the best way.

_SAME = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
Plus = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _steps(cross: np.ndarray, to_az: float, to_hw: float) -> np.ndarray:
    """(n, 2, 2) by from and to; a step keeps the state without a crossing-over and may turn at one."""
    step = np.empty((len(cross), 2, 2))
    step[:, 0, 0], step[:, 0, 1] = (1 - to_az) * (1 - cross), to_az * cross
    step[:, 1, 0], step[:, 1, 1] = to_hw * cross, (1 - to_hw) * (1 - cross)
    with np.errstate(divide="ignore"):
        return np.log(step)


def _product(a: np.ndarray, b: np.ndarray, plus: Plus) -> np.ndarray:
    return plus(a[..., :, 0, None] + b[..., None, 0, :], a[..., :, 1, None] + b[..., None, 1, :])


def _blocks(mats: np.ndarray, plus: Plus) -> np.ndarray:
    """(blocks, width, 2, 2): in blocks of about the root of their number, products of the first 1, 2, ... matrices of the block."""
    width = max(1, int(np.sqrt(len(mats))))
    out = np.concatenate([mats, np.broadcast_to(_SAME, (-len(mats) % width, 2, 2))]).reshape(-1, width, 2, 2).copy()
    for j in range(1, width):
        out[:, j] = _product(out[:, j - 1], out[:, j], plus)
    return out


def _whole(mats: np.ndarray, plus: Plus) -> np.ndarray:
    """The product of all matrices."""
    total = _SAME
    for last in _blocks(mats, plus)[:, -1] if len(mats) else ():
        total = _product(total, last, plus)
    return total


def _along(start: np.ndarray, mats: np.ndarray, plus: Plus) -> np.ndarray:
    """(n + 1, 2): ``start``, and what it becomes after each matrix."""
    if not len(mats):
        return start[None]
    blocks = _blocks(mats, plus)
    enter = np.empty((len(blocks), 2))
    at = start
    for k, last in enumerate(blocks[:, -1]):
        enter[k] = at
        at = plus(at[0] + last[0], at[1] + last[1])
    every = plus(enter[:, 0, None, None] + blocks[:, :, 0], enter[:, 1, None, None] + blocks[:, :, 1]).reshape(-1, 2)
    return np.concatenate([start[None], every[: len(mats)]])


class _Chunk:
    """A sample's sites of a chunk of a contig, in order."""

    def __init__(self, p: pd.DataFrame, to_az: float, to_hw: float) -> None:
        self.rows = p.sort_values("pos", kind="stable")
        self.pos = self.rows["pos"].to_numpy(float)
        self.map = np.array(self.rows["map"].tolist(), float) if "map" in p.columns else None
        emit = np.log(np.maximum(self.rows[["p_hw", "p_az"]].to_numpy(float), 1e-300))
        within = None if self.map is None else self.map[:-1]
        cross = _crossing(within, None if self.map is None else self.map[1:], self.pos[:-1], self.pos[1:])
        self.first = emit[0]
        self.links = _steps(cross, to_az, to_hw) + emit[1:, None, :]

    def edge(self, k: int) -> list[float]:
        return [self.pos[k], *([] if self.map is None else self.map[k])]

    def solved(self, left: np.ndarray, left_best: np.ndarray, right: np.ndarray, right_best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States of the best way and chances of state 1, from what enters on both sides."""
        turned = self.links[::-1].transpose(0, 2, 1)
        both = _along(left + self.first, self.links, np.logaddexp) + _along(right, turned, np.logaddexp)[::-1]
        best = _along(left_best + self.first, self.links, np.maximum) + _along(right_best, turned, np.maximum)[::-1]
        return (best[:, 1] > best[:, 0]).astype("int32"), np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))


def homozygous_runs(sites: DataFrame, *, to_az: float = TO_AZ, to_hw: float = TO_HW, genetic_map: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(sample, chrom, pos, state, p_az) for rows with ``sample``, ``chrom``, ``pos``, ``p_hw``, ``p_az``: the chances of the data in either state.

    From site to site the chance of a crossing-over is that of the map, or ``PER_BASE``
    a base without one; at one the state turns by ``to_az`` and ``to_hw``. A contig is
    entered from one base before its first site, either state being as likely. States
    are those of the best way, chances are by both directions. Rows without chances are
    left out, and so are contigs that the map lacks.

    Exact for any cut into chunks: a chunk of a (sample, chromosome) is reduced to its
    two matrices, the few matrices of a chromosome give each chunk what enters it from
    both sides, and each chunk is solved with that. Rows are shuffled once for both.
    """
    given = ["sample", "chrom", "pos", "p_hw", "p_az"]
    rows = sites.filter("p_hw is not null and p_az is not null").select(*given)
    if genetic_map is not None:
        rows = with_map_points(rows, genetic_map)
    rows = rows.select(*given, *(["map"] if genetic_map is not None else []), F.floor(F.col("pos") / chunk).alias("chunk"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    by = ["sample", "chrom", "chunk"]
    key = ", ".join(f"{c} {kinds[c]}" for c in by)
    steps = lambda a, b: _steps(_crossing(a[:, 1:] if a.shape[1] > 1 else None, b[:, 1:], a[:, 0], b[:, 0]), to_az, to_hw)

    def reduce_chunk(p: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(p, to_az, to_hw)
        mats = {n: c.first[:, None] + _whole(c.links, plus) for n, plus in (("sums", np.logaddexp), ("tops", np.maximum))}
        return p.iloc[:1][by].assign(first=[c.edge(0)], last=[c.edge(-1)], **{n: [m.ravel().tolist()] for n, m in mats.items()})

    def pass_on(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("chunk", kind="stable").reset_index(drop=True)
        first, last = np.array(p["first"].tolist(), float), np.array(p["last"].tolist(), float)
        before = first[:1] - np.eye(1, first.shape[1])  # a base before the first site, between the same points
        step = steps(np.concatenate([before, last[:-1]]), first)
        out = p[by].copy()
        for name, plus in (("sums", np.logaddexp), ("tops", np.maximum)):
            mats = np.array(p[name].tolist(), float).reshape(-1, 2, 2)
            left, right = np.full((len(p), 2), np.log(0.5)), np.zeros((len(p), 2))
            for k in range(len(p)):
                over = left[0] if k == 0 else plus(left[k - 1, 0] + mats[k - 1, 0], left[k - 1, 1] + mats[k - 1, 1])
                left[k] = plus(over[0] + step[k, 0], over[1] + step[k, 1])
                left[k] -= left[k].max()
            for k in range(len(p) - 2, -1, -1):
                over = _product(step[k + 1], mats[k + 1], plus)
                right[k] = plus(over[:, 0] + right[k + 1, 0], over[:, 1] + right[k + 1, 1])
                right[k] -= right[k].max()
            out[f"{name}_sides"] = np.concatenate([left, right], 1).tolist()
        return out

    def solve(p: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"sample": [], "chrom": [], "pos": [], "state": [], "p_az": []})
        c = _Chunk(p, to_az, to_hw)
        sums, tops = (np.array(sides[f"{n}_sides"].iloc[0], float) for n in ("sums", "tops"))
        state, chance = c.solved(sums[:2], tops[:2], sums[2:], tops[2:])
        return c.rows[["sample", "chrom", "pos"]].assign(state=state, p_az=chance)

    matrices = rows.groupBy(*by).applyInPandas(reduce_chunk, f"{key}, first array<double>, last array<double>, sums array<double>, tops array<double>")
    entering = matrices.groupBy("sample", "chrom").applyInPandas(pass_on, f"{key}, sums_sides array<double>, tops_sides array<double>")
    solved = f"sample {kinds['sample']}, chrom {kinds['chrom']}, pos {kinds['pos']}, state int, p_az double"
    return rows.groupBy(*by).cogroup(entering.groupBy(*by)).applyInPandas(solve, solved)


def window_rates(sites: DataFrame, width: int = 100_000) -> DataFrame:
    """Counts only: (sample, chrom, window, from1, to1, sites, hets, rate) for windows of ``width`` positions that have sites."""
    at = F.floor(F.col("pos") / width)
    out = sites.groupBy("sample", "chrom", at.alias("window")).agg(
        F.min("pos").alias("from1"), F.max("pos").alias("to1"), F.count("*").alias("sites"), F.sum(F.col("het").cast("long")).alias("hets")
    )
    return out.withColumn("rate", F.col("hets") / F.col("sites"))
