"""Genotype matrices: one row a site with an array of samples, and what is computed from it.

``samples`` is ARRAY<STRUCT<sample, a, b, dp, gq, phased>> in order of sample; ``a`` and
``b`` are allele numbers, null where missing. A site's array is bounded by the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.keys import site_key


def matrix(genotypes: DataFrame) -> DataFrame:
    """(chrom, pos, samples) from one row for each (site, sample)."""
    by = site_key(genotypes)
    rest = [c for c in genotypes.columns if c not in by]
    first = ["sample"] + [c for c in rest if c != "sample"]
    return genotypes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*first))).alias("samples"))


def called_alleles(samples: Column) -> Column:
    """All allele numbers that are not missing."""
    return F.array_compact(F.flatten(F.transform(samples, lambda s: F.array(s["a"], s["b"]))))


def allele_number(samples: Column) -> Column:
    """AN: called alleles."""
    return F.size(called_alleles(samples))


def allele_counts(samples: Column, n_alts: Column) -> Column:
    """AC: an array with the count of each ALT."""
    called = called_alleles(samples)
    return F.transform(F.sequence(F.lit(1), n_alts), lambda k: F.size(F.filter(called, lambda a: a == k)))


def with_counts(matrix_df: DataFrame) -> DataFrame:
    """Adds ``an``, ``nref`` (all non-reference alleles) to a matrix."""
    called = called_alleles(F.col("samples"))
    return matrix_df.withColumns({"an": F.size(called), "nref": F.size(F.filter(called, lambda a: a > 0))})


def subset_samples(samples: Column, wanted: list[int], exclude: bool = False, known: list[int] | None = None) -> Column:
    """Samples of the list in the list's order, or all others in their order.

    ``known``, the samples that the table has, makes an unknown one an error.
    """
    if known is not None and (unknown := [w for w in wanted if w not in known]):
        raise ValueError(f"no such samples: {unknown}")
    if exclude:
        return F.filter(samples, lambda s: ~s["sample"].isin(wanted))
    picked = F.transform(F.array(*[F.lit(w) for w in wanted]), lambda w: F.get(F.filter(samples, lambda s: s["sample"] == w), F.lit(0)))
    return F.array_compact(picked)


def allele_count(samples: Column, n_alts: Column, kind: str = "nref") -> Column:
    """AC by kind: ``nref`` all non-reference alleles, ``alt1`` the first ALT, ``minor`` the rarer of nref and reference, ``nonmajor`` all but the commonest."""
    called = called_alleles(samples)
    nref = F.size(F.filter(called, lambda a: a > 0))
    if kind == "nref":
        return nref
    if kind == "alt1":
        return F.size(F.filter(called, lambda a: a == 1))
    if kind == "minor":
        return F.least(nref, F.size(called) - nref)
    each = F.transform(F.sequence(F.lit(0), n_alts), lambda k: F.size(F.filter(called, lambda a: a == k)))
    return F.size(called) - F.array_max(each)


def with_frequency(matrix_df: DataFrame, n_alts: Column, kind: str = "nref") -> DataFrame:
    """Adds ``ac``, ``an`` and ``af`` of a kind; ``af`` is null without called alleles, so a filter on it drops the site."""
    x = F.col("samples")
    counted = matrix_df.withColumns({"an": allele_number(x), "ac": allele_count(x, n_alts, kind)})
    return counted.withColumn("af", F.col("ac") / F.nullif(F.col("an"), F.lit(0)))


def is_het(s: Column) -> Column:
    return s["a"] != s["b"]


def is_hom(s: Column) -> Column:
    """Both alleles called and equal; a haploid call (b null, a not) counts as well."""
    return F.when(s["b"].isNull(), s["a"].isNotNull()).otherwise(s["a"] == s["b"])


def is_missing(s: Column) -> Column:
    return s["a"].isNull() & s["b"].isNull()


def set_missing_to_ref(samples: Column) -> Column:
    """Every missing allele becomes the reference, unphased."""
    return F.transform(
        samples,
        lambda s: F.when(
            s["a"].isNull() | s["b"].isNull(),
            s.withField("a", F.coalesce(s["a"], F.lit(0))).withField("b", F.coalesce(s["b"], F.lit(0))).withField("phased", F.lit(False)),
        ).otherwise(s),
    )


def set_failed(samples: Column, keep, to: int | None) -> Column:
    """Genotypes of samples for which ``keep`` is not true become ``to`` (None: missing)."""
    new = F.lit(to).cast("int")
    return F.transform(
        samples,
        lambda s: F.when(F.coalesce(keep(s), F.lit(False)), s).otherwise(s.withField("a", new).withField("b", new).withField("phased", F.lit(False))),
    )


def best_dosage(gp: Column | None, pl: Column | None, s: Column) -> Column:
    """Dosage from what there is: probabilities of three genotypes, else three likelihoods, else the genotype; -1 without any."""
    ways = []
    if gp is not None:
        ways.append(F.when((F.size(gp) == 3) & F.forall(gp, lambda x: x.isNotNull()), F.get(gp, F.lit(1)) + 2 * F.get(gp, F.lit(2))))
    if pl is not None:
        ways.append(F.when((F.size(pl) == 3) & F.forall(pl, lambda x: x.isNotNull()), likelihood_dosage(pl)))
    return F.coalesce(*ways, dosage(s).cast("double"))


def dosage(s: Column) -> Column:
    """Number of non-reference alleles of a genotype; -1 if any is missing."""
    return F.coalesce((s["a"] > 0).cast("int") + (s["b"] > 0).cast("int"), F.lit(-1))


def likelihood_dosage(pl: Column) -> Column:
    """Expected non-reference alleles from three likelihoods on a natural exponential scale."""
    p = F.transform(pl, lambda x: F.exp(-0.1 * x))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(pl) == 3, (F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2))) / total).otherwise(-1.0)
