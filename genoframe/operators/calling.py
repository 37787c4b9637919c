"""Genotype calling from likelihoods.

Likelihoods are phred-scaled arrays, one value for each unordered genotype of a
sample. Formula-level parts are Columns; the search for the best set of alleles, the
consensus call and the bias tests are numpy kernels over batches of sites of one shape.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genetics import genotype_index, let
from genoframe.functions.special import chi2_upper, fisher_exact, minimise, one_sided_t
from genoframe.operators.reshape import renumber

#: The expected share of variant sites, fixed; and what a reference without quality is given: that of one good read where sums are unscaled, else a small share.
THETA, GOOD_READ, SMALL_SHARE = 1e-3, 32.0, 1e-3


def pl_to_prob(pl: Column) -> Column:
    """Normalised genotype probabilities of an array of PL; all missing gives zeros."""
    p = F.transform(pl, lambda x: F.coalesce(F.pow(F.lit(10.0), -x / 10), F.lit(0.0)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def normalised_quality_sums(qs: Column) -> Column:
    """Allele frequency prior from summed qualities; a reference without any gets ``GOOD_READ`` where the sums are over 2, else ``SMALL_SHARE``."""
    sum_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    least = F.when(sum_of(qs) > 2, GOOD_READ).otherwise(SMALL_SHARE)
    first = F.when(F.get(qs, F.lit(0)) == 0, least).otherwise(F.get(qs, F.lit(0)))
    whole = F.concat(F.array(first), F.slice(qs, 2, F.size(qs)))
    return let(whole, lambda w: let(sum_of(w), lambda total: F.transform(w, lambda x: x / total)))


def watterson(theta: float, n_samples: int) -> float:
    """log of the prior for a variant allele among ``2 n`` chromosomes; 0.99 if it is 1 or more."""
    prior = theta * sum(1 / i for i in range(1, max(2, 2 * n_samples)))
    return math.log(prior if prior < 1 else 0.99)


def genotype_quality(p: Column) -> Column:
    """Phred of the chance that the best genotype is wrong, at most 127."""
    best, total = F.array_max(p), F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(127), F.rint(-10 * F.log10(F.greatest(1 - best / total, F.lit(1e-13)))).cast("int"))


def site_kernel(prob: np.ndarray, qs: np.ndarray, theta: float = THETA) -> tuple[list[int], float, list[tuple[int, int]]]:
    """Best set of at most three alleles, QUAL and genotypes of a site.

    ``prob`` (samples, genotypes), ``qs`` (alleles) the frequency prior. The score of a
    set is the summed log of the expected likelihood under its renormalised
    frequencies, plus the prior for each allele but the reference.
    """
    n_alleles = len(qs)
    pairs = [(i, j) for j in range(n_alleles) for i in range(j + 1)]
    known = prob.sum(axis=1) > 0
    prior = watterson(theta, len(prob))
    scored = []
    for size in (1, 2, 3):
        for chosen in combinations(range(n_alleles), size):
            if size > 1 and 0 not in chosen:
                continue
            f = np.zeros(n_alleles)
            f[list(chosen)] = qs[list(chosen)]
            if f.sum() <= 0:
                continue
            f /= f.sum()
            weight = np.array([f[i] * f[j] * (1 if i == j else 2) for i, j in pairs])
            value = float(np.log(np.maximum(prob[known] @ weight, 1e-300)).sum()) + prior * len(set(chosen) - {0})
            scored.append((value, chosen))
    if not scored:
        return [0], 0.0, [(-1, -1)] * len(prob)
    best, chosen = max(scored)
    ref = next((v for v, c in scored if c == (0,)), -math.inf)
    top = max(v for v, _ in scored)
    total = top + math.log(sum(math.exp(v - top) for v, _ in scored))
    if chosen == (0,):
        other = [v for v, c in scored if c != (0,)]
        quality = 4.343 * (total - max(other)) if other else 999.0
    else:
        quality = 4.343 * (total - ref)
    keep = sorted({0, *chosen})
    f = np.zeros(n_alleles)
    f[keep] = qs[keep]
    f /= f.sum()
    allowed = np.array([f[i] * f[j] * (1 if i == j else 2) if i in keep and j in keep else 0.0 for i, j in pairs])
    calls = [pairs[int(k)] if ok else (-1, -1) for k, ok in zip(_likeliest(prob * allowed, np.array(pairs)), known)]
    return keep, min(999.0, max(0.0, quality)), calls


def batch_kernel(prob: np.ndarray, qs: np.ndarray, theta: float = THETA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`site_kernel` for many sites of one shape: kept alleles (sites, alleles), QUAL, best genotypes (sites, samples; -1 missing).

    ``prob`` (sites, samples, genotypes), ``qs`` (sites, alleles).
    """
    n_alleles = qs.shape[1]
    pairs = np.array([(i, j) for j in range(n_alleles) for i in range(j + 1)])
    twice = np.where(pairs[:, 0] == pairs[:, 1], 1.0, 2.0)
    known = prob.sum(axis=2) > 0
    prior = watterson(theta, prob.shape[1])
    sets = [c for size in (1, 2, 3) for c in combinations(range(n_alleles), size) if size == 1 or 0 in c]
    inside = np.array([[k in c for k in range(n_alleles)] for c in sets])
    values = np.full((len(qs), len(sets)), -np.inf)
    for k, chosen in enumerate(inside):
        f = qs * chosen
        total = f.sum(axis=1)
        f = f / np.where(total > 0, total, 1)[:, None]
        weight = f[:, pairs[:, 0]] * f[:, pairs[:, 1]] * twice
        fits = np.log(np.maximum(np.einsum("sng,sg->sn", prob, weight), 1e-300))
        values[:, k] = np.where(total > 0, (fits * known).sum(axis=1) + prior * chosen[1:].sum(), -np.inf)
    # Of equal scores the larger set in order of alleles wins, as tuples compare.
    order = sorted(range(len(sets)), key=lambda k: sets[k], reverse=True)
    best = np.array(order)[values[:, order].argmax(axis=1)]
    top = values.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0)
    total = safe + np.log(np.maximum(np.exp(values - safe[:, None]).sum(axis=1), 1e-300))
    ref = sets.index((0,))
    other = np.delete(values, ref, axis=1)
    other = other.max(axis=1) if other.shape[1] else np.full(len(qs), -np.inf)
    with np.errstate(invalid="ignore"):
        quality = 4.343 * np.where(best == ref, np.where(np.isfinite(other), total - other, np.inf), total - values[:, ref])
    quality = np.where(np.isfinite(top), np.clip(quality, 0, 999), 0)
    keep = inside[best]
    keep[:, 0] = True
    f = qs * keep
    f = f / np.maximum(f.sum(axis=1), 1e-300)[:, None]
    allowed = f[:, pairs[:, 0]] * f[:, pairs[:, 1]] * twice * keep[:, pairs[:, 0]] * keep[:, pairs[:, 1]]
    calls = np.where(known, _likeliest(prob * allowed[:, None, :], pairs), -1)
    return keep, quality, np.where(np.isfinite(top)[:, None], calls, -1)


def _likeliest(chance: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best genotype (last axis); of equals a homozygous one, the first of its kind."""
    order = np.argsort(pairs[:, 0] != pairs[:, 1], kind="stable")
    return order[chance[..., order].argmax(axis=-1)]


def by_shape(rows: pd.DataFrame, column: str) -> Iterator[np.ndarray]:
    """Row numbers of a batch in groups whose arrays (samples by genotypes) have one shape."""
    shapes = pd.Series([(len(x), len(x[0]) if len(x) else 0) for x in rows[column]])
    for _, own in shapes.groupby(shapes).groups.items():
        yield np.asarray(own)


#: Fixed values of genotype qualities: phred of a natural logarithm, and the largest.
PHRED, BEST_GQ = 4.34294, 127


def call_sites(sites: DataFrame, *, theta: float = THETA) -> DataFrame:
    """(key, alleles, qual, genotypes, gq, gp, pl) for rows with ``key``, ``pls`` (an array of samples' PL arrays) and ``qs``.

    Sites of a batch are taken together by their numbers of samples and alleles. ``gq``:
    phred of the chance that a sample's genotype is wrong, without its fraction, at most
    ``BEST_GQ``; ``gp``: phred of each genotype's chance, likewise; ``pl``: the
    likelihoods; both of the genotypes of the alleles kept. A sample without information
    has ``./.`` and zeros.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            out: dict[str, list] = {"alleles": [None] * len(b), "qual": [0.0] * len(b), **{c: [None] * len(b) for c in ("genotypes", "gq", "gp", "pl")}}
            for own in by_shape(b, "pls"):
                pl = np.array([np.stack([np.asarray(x, float) for x in b["pls"][k]]) for k in own])
                p = np.nan_to_num(10.0 ** (-pl / 10))
                p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
                q = np.stack([np.asarray(b["qs"][k], float) for k in own])
                total = q.sum(axis=1, keepdims=True)
                q = np.where(total > 0, q / np.where(total > 0, total, 1), 1 / q.shape[1])
                keep, quality, calls = batch_kernel(p, q, theta)
                names = np.array([f"{i}/{j}" for j in range(q.shape[1]) for i in range(j + 1)] + ["./."])
                pairs = np.array([(i, j) for j in range(q.shape[1]) for i in range(j + 1)])
                f = q * keep
                f /= np.maximum(f.sum(axis=1), 1e-300)[:, None]
                post = p * (f[:, pairs[:, 0]] * f[:, pairs[:, 1]] * np.where(pairs[:, 0] == pairs[:, 1], 1.0, 2.0))[:, None, :]
                post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
                told = calls >= 0
                gq = np.where(told, np.minimum(BEST_GQ, -PHRED * np.log(np.maximum(1 - post.max(axis=2), 1e-300))), 0).astype(int)
                gp = np.where(told[..., None], -PHRED * np.log(np.maximum(post, 1e-300)), 0).astype(int)
                kept = keep[:, pairs[:, 0]] & keep[:, pairs[:, 1]]
                for n, k in enumerate(own):
                    out["alleles"][k], out["qual"][k] = np.flatnonzero(keep[n]).tolist(), float(quality[n])
                    out["genotypes"][k], out["gq"][k] = names[calls[n]].tolist(), gq[n].tolist()
                    out["gp"][k] = gp[n][:, kept[n]].tolist()
                    out["pl"][k] = [[None if np.isnan(v) else v for v in x] for x in pl[n][:, kept[n]].tolist()]
            yield b[["key"]].assign(**out)

    kind = sites.schema["key"].dataType.simpleString()
    return sites.select("key", "pls", "qs").mapInPandas(call, f"key {kind}, alleles array<int>, qual double, genotypes array<string>, gq array<int>, gp array<array<int>>, pl array<array<double>>")


def fill_unseen(pls: Column, n_alleles: Column) -> Column:
    """PL arrays in which missing values of real alleles are taken from those of the last, unseen allele; arrays that are all missing stay."""
    last = n_alleles - 1

    def one(pl: Column) -> Column:
        filled = F.flatten(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda j: F.transform(
                    F.sequence(F.lit(0), j),
                    lambda i: F.coalesce(
                        F.get(pl, genotype_index(i, j)), F.when(i != j, F.coalesce(F.get(pl, genotype_index(i, last)), F.get(pl, genotype_index(j, last)))), F.get(pl, genotype_index(last, last))
                    ),
                ),
            )
        )
        return F.when(F.exists(pl, lambda x: x.isNotNull()), filled).otherwise(pl)

    return F.transform(pls, one)


def reference_genotypes(pls: Column) -> Column:
    """Genotypes of a site without ALT: 0/0, or missing where a sample has no likelihood or all are alike (no depth)."""
    seen = lambda pl: F.exists(pl, lambda x: x.isNotNull() & (x != F.coalesce(F.get(pl, F.lit(0)), F.lit(-1.0)))) | F.exists(pl, lambda x: x > 0)
    return F.transform(pls, lambda pl: F.when(F.coalesce(seen(pl), F.lit(False)), "0/0").otherwise("./."))


def constrained_to_targets(sites: DataFrame, targets: DataFrame, *, insert_missed: bool = False) -> DataFrame:
    """Sites with the alleles of ``targets`` (``chrom``, ``pos``, ``alleles``, REF first) and likelihoods put in their order.

    Sites that are no target go. A target's ALT that the site lacks takes the
    likelihoods of its unseen allele (its last ALT, ``<*>``) or null. With
    ``insert_missed``, targets without a site are added with null ``pls``.
    """
    wanted = targets.select("chrom", "pos", F.col("alleles").alias("_want"))
    both = wanted.join(sites, ["chrom", "pos"], "left" if insert_missed else "inner")
    own = F.concat(F.array("ref"), F.col("alts"))
    unseen = F.when(F.element_at(own, -1).isin("<*>", "<X>", "X"), F.size(own) - 1)
    src = F.transform("_want", lambda a: F.coalesce(F.nullif(F.array_position(own, a).cast("int"), F.lit(0)) - 1, unseen))
    both = both.withColumn("_src", F.when(F.col("ref").isNotNull(), src))
    out = {
        "pls": F.when(F.col("_src").isNotNull(), F.transform("pls", lambda pl: renumber(pl, F.col("_src"), "G", F.size(own)))),
        "qs": F.when(F.col("_src").isNotNull(), renumber(F.col("qs"), F.col("_src"), "R", F.size(own))),
    }
    both = both.withColumns({c: v for c, v in out.items() if c in sites.columns})
    names = {"ref": F.get("_want", F.lit(0)), "alts": F.slice("_want", 2, F.size("_want"))}
    return both.withColumns(names).select(*sites.columns)


# --- trios -------------------------------------------------------------------


def trio_table(n_alleles: int, kind: str = "autosome") -> list[tuple[int, int, int, float]]:
    """(father, mother, child, chance of the child) of all genotypes that Mendel allows, as places among likelihoods.

    ``kind``: ``autosome``; ``x-boy`` (father and child have one copy, from the mother),
    ``x-girl`` (father has one copy). A single copy is written as its homozygous place.
    """
    pairs = [(i, j) for j in range(n_alleles) for i in range(j + 1)]
    place = {p: k for k, p in enumerate(pairs)}
    out = []
    for f in pairs:
        if kind != "autosome" and f[0] != f[1]:
            continue
        for m in pairs:
            seen: dict[int, int] = {}
            for b in m:
                for a in (b,) if kind == "x-boy" else f:
                    k = place[tuple(sorted((a, b)))]
                    seen[k] = seen.get(k, 0) + 1
            out += [(place[f], place[m], k, n / sum(seen.values())) for k, n in sorted(seen.items())]
    return out


def new_indel_rate(length: Column, scale: float = 1.0) -> Column:
    """Share of indels of a (signed) length that Mendel explains, where the rate of new ones falls with the length."""
    rate = F.when(length < 0, F.exp(-21.9313 - 0.2856 * length)).otherwise(F.exp(-22.8689 + 0.2994 * length))
    return 1 - scale * rate


def call_trios(trios: DataFrame, *, mendel: Column | float = 1 - 1e-8, kind: str = "autosome", most_alleles: int = 4) -> DataFrame:
    """Adds ``unconstrained``, ``constrained`` (places of the genotypes of father, mother, child; -1 missing) and ``de_novo``.

    Rows have ``father``, ``mother``, ``child``: log chances of the genotypes, null where
    a sample has no depth. ``mendel``: how far the law is trusted. Of all combinations
    the likeliest (in nine digits; of equals the first) is taken, those that Mendel forbids at the chance that he is wrong.
    """
    people = ("father", "mother", "child")
    place = lambda p: F.coalesce(F.array_position(p, F.array_max(p)).cast("int") - 1, F.lit(-1))
    free = F.array(*[place(F.col(p)) for p in people])
    n_genotypes = F.coalesce(*[F.size(F.when(F.col(p).isNotNull(), F.col(p))) for p in people])
    kept = F.lit(mendel) if isinstance(mendel, float) else mendel
    all_there = F.lit(True)
    for p in people:
        all_there = all_there & F.col(p).isNotNull()
    best = F.lit(None).cast("struct<lk:double,f:int,m:int,c:int,ok:boolean>")
    for n in range(2, most_alleles + 1):
        rows = ",".join(f'{{"f":{f},"m":{m},"c":{c},"p":{p}}}' for f, m, c, p in trio_table(n, kind))
        table = F.from_json(F.lit(f"[{rows}]"), "array<struct<f:int,m:int,c:int,p:double>>")

        def scored(t: Column) -> Column:
            lk = F.lit(0.0)
            for p, k in zip(people, "fmc"):
                lk = lk + F.coalesce(F.get(F.col(p), t[k]), F.lit(0.0))
            lk = lk + F.log(1 - kept * (1 - F.when(all_there, t["p"]).otherwise(1.0)))
            lk = F.round(lk, 9)  # combinations that are alike may differ in their last digits
            return F.struct(lk.alias("lk"), (-t["f"]).alias("f"), (-t["m"]).alias("m"), (-t["c"]).alias("c"))

        top = F.array_max(F.transform(table, scored))
        lawful = F.exists(table, lambda t: (t["f"] == F.get(free, F.lit(0))) & (t["m"] == F.get(free, F.lit(1))) & (t["c"] == F.get(free, F.lit(2))))
        found = F.struct(top["lk"].alias("lk"), (-top["f"]).alias("f"), (-top["m"]).alias("m"), (-top["c"]).alias("c"), lawful.alias("ok"))
        best = F.when(n_genotypes == n * (n + 1) // 2, found).otherwise(best)
    out = trios.withColumns({"unconstrained": free, "_best": best})
    alone = F.lit(0.0)
    for p in people:
        alone = alone + F.coalesce(F.array_max(p), F.lit(0.0))
    broken = all_there & ~F.col("_best.ok") & (alone + F.log(1 - kept) > F.col("_best.lk"))
    lawful = F.array(*[F.when(F.col(p).isNotNull(), F.col(f"_best.{k}")).otherwise(-1) for p, k in zip(people, "fmc")])
    out = out.withColumns({"de_novo": F.coalesce(broken, F.lit(False))})
    return out.withColumn("constrained", F.when(F.col("de_novo"), F.col("unconstrained")).otherwise(lawful)).drop("_best")


# --- annotations of calls ------------------------------------------------------


def inbreeding(nref: Column, nalt: Column, hets: Column, diploid: Column) -> tuple[Column, Column]:
    """(ICB, HOB): how likely so many heterozygotes are against the likeliest number, and how far their share is from expected.

    Binomial; normal where both numbers expected exceed 10 or there are more than 200
    samples. Null where REF, ALT or samples are lacking.
    """
    n = F.nullif(nref + nalt, F.lit(0)).cast("double")
    there = (nref > 0) & (nalt > 0) & (diploid > 0)
    q = 2 * nref * nalt / (n * n)
    mean = q * diploid
    normal = F.exp(-0.5 * (hets - mean) * (hets - mean) / F.nullif(mean * (1 - q), F.lit(0.0)))
    low, high = F.least(F.floor(mean), hets).cast("int"), F.greatest(F.floor(mean), hets).cast("int")
    steps = F.filter(F.sequence(low, high), lambda k: k > low)
    ratio = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.log((diploid - k + 1) / k * q / (1 - q)))
    binomial = F.exp(F.when(hets >= F.floor(mean), ratio).otherwise(-ratio))
    icb = F.when(((mean > 10) & ((1 - q) * diploid > 10)) | (diploid > 200), normal).otherwise(binomial)
    return F.when(there, icb), F.when(there, F.abs(hets / F.nullif(diploid, F.lit(0)) - q))


def bias_tests(sites: DataFrame, anno: str = "i16") -> DataFrame:
    """Adds ``dp4``, ``mq`` and ``pv4`` of 16 sums: counts by strand, then sums and squares of qualities for REF and ALT.

    ``pv4``: Fisher's test of strands, then three one-sided t-tests (REF above ALT) of
    base quality, mapping quality and distance to the end; null without REF or ALT bases.
    ``mq``: root mean square of the mapping quality, null without depth.
    """

    @F.pandas_udf("dp4 array<int>, mq int, pv4 array<double>")
    def run(sums: pd.Series) -> pd.DataFrame:
        own = np.array([k for k, v in enumerate(sums) if v is not None and len(v) == 16], int)
        x = np.stack([np.asarray(sums.iloc[k], float) for k in own]) if len(own) else np.zeros((0, 16))
        ref, alt = x[:, 0] + x[:, 1], x[:, 2] + x[:, 3]
        tests = [one_sided_t(ref, alt, x[:, k], x[:, k + 1], x[:, k + 2], x[:, k + 3]) for k in (4, 8, 12)]
        cells = x[:, :4].astype(int)
        tables, which = np.unique(cells, axis=0, return_inverse=True)
        strand = np.array([fisher_exact(*map(int, r)) for r in tables])[which.reshape(-1)] if len(own) else np.zeros(0)  # few tables differ
        depth = ref + alt
        mq = np.floor(np.sqrt((x[:, 9] + x[:, 11]) / np.maximum(depth, 1)) + 0.499).astype(int)
        out = pd.DataFrame({c: pd.Series([None] * len(sums), dtype=object) for c in ("dp4", "mq", "pv4")})
        pv4 = np.stack([strand, *tests], axis=1).tolist()
        for c, values, given in (("dp4", cells.tolist(), np.ones(len(own), bool)), ("mq", mq.tolist(), depth > 0), ("pv4", pv4, (ref > 0) & (alt > 0))):
            made = [None] * len(sums)
            for k, v, ok in zip(own, values, given):
                made[k] = v if ok else None
            out[c] = pd.Series(made, dtype=object)
        return out

    return sites.select("*", run(F.col(anno).cast("array<double>")).alias("_t")).select("*", "_t.*").drop("_t")


# --- frequencies ---------------------------------------------------------------


def count_likelihood(prob: np.ndarray) -> np.ndarray:
    """(sites, 2 n + 1): log likelihoods of the number of non-reference alleles among n diploid samples, but for a constant of the site.

    ``prob`` (sites, n, 3): likelihoods of 0, 1, 2 non-reference alleles. That of each
    number is built up sample by sample (a convolution with weights 1, 2, 1) and divided
    by the number of ways. A sample with no information has three equal likelihoods.
    """
    sites, n, _ = prob.shape
    z = np.zeros((sites, 2 * n + 1))
    z[:, 0] = 1
    for s in range(n):
        p = prob[:, s]
        new = z * p[:, :1]
        new[:, 1:] += 2 * z[:, :-1] * p[:, 1:2]
        new[:, 2:] += z[:, :-2] * p[:, 2:3]
        z = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
    ways = np.array([math.lgamma(2 * n + 1) - math.lgamma(x + 1) - math.lgamma(2 * n - x + 1) for x in range(2 * n + 1)])
    with np.errstate(divide="ignore"):
        return np.log(z) - ways


def frequency_posterior(prob: np.ndarray, theta: float = 1e-3, *, folded: bool = False) -> np.ndarray:
    """(sites, 2 n + 1): the posterior of that number under the neutral prior theta / k; ``folded``: under the mean of it and its mirror image, which does not know the reference."""
    like = count_likelihood(prob)
    k = np.arange(like.shape[1])
    prior = np.where(k > 0, theta / np.maximum(k, 1), 0.0)
    prior[0] = max(1e-10, 1 - prior[1:].sum())
    log_post = like + np.log((prior + prior[::-1]) / 2 if folded else prior)
    post = np.exp(log_post - log_post.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True)


def credible_interval(post: np.ndarray, outside: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The equal-tailed interval of the frequency: the first numbers from either end at which more than half of ``outside`` is passed."""
    m = post.shape[1] - 1
    low = (np.cumsum(post, axis=1) > outside / 2).argmax(axis=1)
    high = m - (np.cumsum(post[:, ::-1], axis=1) > outside / 2).argmax(axis=1)
    return low / m, high / m


def estimate_frequency(prob: np.ndarray, tries: int = 10, eps: float = 1e-5) -> np.ndarray:
    """Non-reference frequency of each site: EM, and where it has not settled after ``tries`` the likelihood's maximum by :func:`minimise`."""
    f = np.full(len(prob), 0.2)
    settled = np.zeros(len(prob), bool)
    for _ in range(tries):
        w = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], axis=1)[:, None, :] * prob
        new = ((w[..., 1] + 2 * w[..., 2]) / np.maximum(w.sum(axis=2), 1e-300)).mean(axis=1) / 2
        settled |= np.abs(new - f) < eps
        f = new
    if not settled.all():
        rest = prob[~settled]

        def loss(x: np.ndarray) -> np.ndarray:
            w = np.stack([(1 - x) ** 2, 2 * x * (1 - x), x**2], axis=1)[:, None, :] * rest
            return -np.log(np.maximum(w.sum(axis=2), 1e-300)).sum(axis=1)

        f[~settled] = minimise(loss, np.zeros(len(rest)), np.ones(len(rest)))
    return f


def genotype_frequencies(prob: np.ndarray, rounds: int = 50) -> np.ndarray:
    """(sites, 3): genotype frequencies without Hardy-Weinberg, by EM."""
    g = np.full((len(prob), 3), 1 / 3)
    for _ in range(rounds):
        w = prob * g[:, None, :]
        g = (w / np.maximum(w.sum(axis=2, keepdims=True), 1e-300)).mean(axis=1)
    return g


def consensus_call(sites: DataFrame, *, p_variant: float = 0.5, theta: float = 1e-3) -> DataFrame:
    """(key, af1, ac1, ci_low, ci_high, g3, hwe, lrt, fq, p_ref, qual, is_variant, genotypes) for rows with ``key`` and ``pls`` (three likelihoods a sample).

    ``af1``: the frequency's estimate; ``ac1``: the number of non-reference alleles that
    fits best; ``ci_low``, ``ci_high``: the 95% interval of the frequency; ``g3`` and ``hwe``: genotype frequencies and the chance of so large a departure
    from Hardy-Weinberg, null above 0.05; ``lrt``: the chance of a better fit by them alone;
    ``fq``: phred that all samples are alike under the folded prior, negative if so; a site is a variant if the
    chance of no ALT is below ``p_variant``. Genotypes are the likeliest under ``af1``.
    """

    names = np.array(["0/0", "0/1", "1/1", "./."])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pls = b.column("pls")
            samples = pls.flatten()
            if pls.null_count or samples.null_count or (pc.min(pc.list_value_length(samples)).as_py() or 3) < 3:
                raise ValueError("three likelihoods a sample are needed")
            first = samples.offsets.to_numpy()[:-1] - samples.offsets[0].as_py()
            values = np.asarray(samples.flatten().to_numpy(zero_copy_only=False), float)
            out = {c: np.zeros(b.num_rows) for c in ("af1", "ac1", "ci_low", "ci_high", "hwe", "lrt", "fq", "p_ref", "qual")}
            g3, sizes = np.zeros((b.num_rows, 3)), pc.list_value_length(pls).to_numpy()
            calls = np.zeros(len(samples), int)
            for own, at in _by_length(sizes):
                pl = values[first[at][:, :, None] + np.arange(3)]
                p = np.nan_to_num(10.0 ** (-pl / 10), nan=1.0)
                f, g, post = estimate_frequency(p), genotype_frequencies(p), frequency_posterior(p, theta)
                n = p.shape[1]
                free = np.log(np.maximum((p * g[:, None, :]).sum(axis=2), 1e-300)).sum(axis=1)
                hw = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], axis=1)
                bound = np.log(np.maximum((p * hw[:, None, :]).sum(axis=2), 1e-300)).sum(axis=1)
                share = (g[:, 1] + 2 * g[:, 2]) / 2
                want = np.stack([(1 - share) ** 2, 2 * share * (1 - share), share**2], axis=1)
                chance = chi2_upper(n * ((g - want) ** 2 / np.maximum(want, 1e-12)).sum(axis=1), 1)
                lrt = chi2_upper(np.maximum(0, 2 * (free - bound)), 1)
                p_ref, folded = post[:, 0], frequency_posterior(p, theta, folded=True)
                alike = np.minimum(1.0, folded[:, 0] + folded[:, 2 * n])
                count, (low, high) = np.round(count_likelihood(p), 9).argmax(axis=1), credible_interval(post)  # of equal fits the least
                r = np.where(p_ref < p_variant, p_ref, 1 - p_ref)
                phred = lambda x: np.minimum(999, -4.343 * np.log(np.maximum(x, 1e-300)))
                fq = np.where(alike < 0.5, phred(alike), -phred(1 - alike))
                blank = (np.ptp(p, axis=2) == 0)
                calls[at] = np.where(blank, 3, (p * hw[:, None, :]).argmax(axis=2))
                g3[own] = g
                for c, x in zip(out, (f, count, low, high, chance, lrt, fq, p_ref, phred(r))):
                    out[c][own] = x
            sure = out["hwe"] <= 0.05
            made = {c: pa.array(x, from_pandas=True, mask=~sure if c == "hwe" else None) for c, x in out.items()}
            made["ac1"] = pa.array(out["ac1"].astype(np.int32))
            made["g3"] = pa.ListArray.from_arrays(_offsets(np.where(sure, 3, 0)), pa.array(g3[sure].ravel()), mask=pa.array(~sure))
            made["is_variant"] = pa.array(out["p_ref"] < p_variant)
            made["genotypes"] = pa.ListArray.from_arrays(_offsets(sizes), pa.array(names.astype(object), pa.string()).take(pa.array(calls)))
            order = ["af1", "ac1", "ci_low", "ci_high", "g3", "hwe", "lrt", "fq", "p_ref", "qual", "is_variant", "genotypes"]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[made[c] for c in order]], names=["key", *order])

    kind = sites.schema["key"].dataType.simpleString()
    return sites.select("key", F.col("pls").cast("array<array<double>>").alias("pls")).mapInArrow(
        call, f"key {kind}, af1 double, ac1 int, ci_low double, ci_high double, g3 array<double>, hwe double, lrt double, fq double, p_ref double, qual double, is_variant boolean, genotypes array<string>"
    )


def _by_length(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lists one after the other: numbers of those of one length, and where their values are (lists by length)."""
    start = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        yield own, start[own][:, None] + np.arange(n)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


def allele_frequency_em(counts: DataFrame, key: str | list[str], rounds: int = 20) -> DataFrame:
    """Non-reference allele frequency by EM over three genotype likelihoods a sample.

    One row for each (site, sample) with ``g0``, ``g1``, ``g2``; the data are shuffled once,
    and the rounds go over batches of sites of one number of samples. A sample with a null adds nothing.
    """
    by = [key] if isinstance(key, str) else key
    each = F.struct(*[F.col(c).cast("double").alias(c) for c in ("g0", "g1", "g2")])
    sites = counts.groupBy(*by).agg(F.sort_array(F.collect_list(each)).alias("_g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_g")
            parts = lists.flatten().flatten()
            sizes = pc.list_value_length(lists).to_numpy()
            g0, g1, g2 = (np.asarray(x.to_numpy(zero_copy_only=False), float) for x in parts)
            lacks = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in parts], axis=0)
            af = np.zeros(batch.num_rows)
            for own, at in _by_length(sizes):
                x, y, z, void = g0[at], g1[at], g2[at], lacks[at]
                f = np.full((len(own), 1), 0.2)
                for _ in range(rounds):
                    a, b, c = x * (1 - f) * (1 - f), y * 2 * f * (1 - f), z * f * f
                    total = a + b + c
                    none = void | (total == 0)
                    share = np.where(none, 0.0, (b + 2 * c) / np.where(none, 1.0, total))
                    f = np.cumsum(share, axis=1)[:, -1:] / (2 * at.shape[1])
                af[own] = f[:, 0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], pa.array(af), pa.array(sizes.astype(np.int32))], names=[*by, "af", "samples"])

    kinds = "".join(f"`{c}` {counts.schema[c].dataType.simpleString()}, " for c in by)
    return sites.mapInArrow(run, f"{kinds}af double, samples int")


def hardy_weinberg_chi2(n0: Column, n1: Column, n2: Column) -> Column:
    """Chi-square of genotype counts against Hardy-Weinberg proportions; 0 without variation."""
    n = (n0 + n1 + n2).cast("double")
    p = (2 * n0 + n1) / F.nullif(2 * n, F.lit(0.0))
    q = 1 - p
    part = lambda seen, want: (seen - want) * (seen - want) / F.nullif(want, F.lit(0.0))
    return F.coalesce(part(n0, n * p * p) + part(n1, 2 * n * p * q) + part(n2, n * q * q), F.lit(0.0))


def mendel_errors(trios: DataFrame) -> DataFrame:
    """Adds ``consistent``: the child (``ca``, ``cb``) takes one allele from each parent (``fa``.., ``ma``..)."""
    takes = lambda x, a, b: (F.col(x) == F.col(a)) | (F.col(x) == F.col(b))
    one = takes("ca", "fa", "fb") & takes("cb", "ma", "mb")
    other = takes("cb", "fa", "fb") & takes("ca", "ma", "mb")
    return trios.withColumn("consistent", one | other)
