"""Scalar functions over alleles and genotypes, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SNP, INDEL, MNP, OTHER = 1, 2, 4, 8
_NAMES = ((SNP, "SNP"), (INDEL, "INDEL"), (MNP, "MNP"), (OTHER, "OTHER"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; other letters -1."""
    return F.when(F.length(base) == 1, F.instr(F.lit("ACGT"), F.upper(base)) - 1).otherwise(-1)


def is_transition(ref: Column, alt: Column) -> Column:
    return F.abs(base_code(ref) - base_code(alt)) == 2


def allele_type(ref: Column, alt: Column) -> Column:
    """The type bit of one ALT: symbolic OTHER, equal length SNP (one base differs) or MNP, else INDEL if one is a prefix-anchored form."""
    same = F.length(ref) == F.length(alt)
    n_diff = F.size(F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substr(ref, i, F.lit(1)) != F.substr(alt, i, F.lit(1))))
    symbolic = alt.rlike(r"[<>\[\]*]")
    anchored = F.startswith(alt, F.substr(ref, F.lit(1), F.lit(1)))
    single = (F.length(ref) == 1) & (F.length(alt) == 1) & alt.isin(*"ACGTN")
    return (
        F.when(single & (ref != alt), SNP)  # most sites: no walk along the alleles
        .when(symbolic, OTHER)
        .when(ref == alt, 0)
        .when(same & (n_diff == 1), SNP)
        .when(same, MNP)
        .when(anchored, INDEL)
        .otherwise(OTHER)
    )


def type_mask(ref: Column, alts: Column) -> Column:
    """OR of the type bits over all ALTs; 0 without ALT."""
    return F.aggregate(alts, F.lit(0), lambda m, a: m.bitwiseOR(allele_type(ref, a)))


def type_names(mask: Column) -> Column:
    """``REF``, or the comma list of the types in a mask."""
    parts = F.array_compact(F.array(*[F.when(mask.bitwiseAND(b) != 0, n) for b, n in _NAMES]))
    return F.when(mask == 0, "REF").otherwise(F.array_join(parts, ","))


def indel_length(ref: Column, alt: Column) -> Column:
    """Positive for insertions, negative for deletions."""
    return F.length(alt) - F.length(ref)


def genotype_index(i: Column, j: Column) -> Column:
    """Place of the unordered diploid genotype i/j among likelihoods."""
    hi, lo = F.greatest(i, j), F.least(i, j)
    return (hi * (hi + 1) / 2).cast("int") + lo


def genotype_alleles(k: Column) -> Column:
    """The inverse of :func:`genotype_index`: (i, j) with i <= j of a place among likelihoods."""
    j = F.floor((F.sqrt(8 * k + 1) - 1) / 2).cast("int")
    return F.struct((k - j * (j + 1) / 2).cast("int").alias("i"), j.alias("j"))


def compatible_refs(a: Column, b: Column) -> Column:
    """Whether two REF alleles of one position can be of one reference: one begins with the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def phred_to_prob(pl: Column) -> Column:
    return F.pow(F.lit(10.0), -pl / 10)


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials of an array of doubles, without overflow."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def genotype_string(alleles: Column, phased: Column) -> Column:
    """``0/1``, ``0|1``, ``.``: codes joined by the phase mark, missing ones as dots."""
    return _joined(F.transform(alleles, lambda a: F.coalesce(a.cast("string"), F.lit("."))), phased)


def _joined(shown: Column, phased: Column) -> Column:
    return F.when(phased, F.array_join(shown, "|")).otherwise(F.array_join(shown, "/"))


def translated_genotype(alleles: Column, phased: Column, all_alleles: Column) -> Column:
    """Like :func:`genotype_string`, with the alleles' letters."""
    shown = F.transform(alleles, lambda a: F.coalesce(F.get(all_alleles, a), F.lit(".")))
    return _joined(shown, phased)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def iupac(a: Column, b: Column) -> Column:
    """Ambiguity code of two bases."""
    return F.substr(F.lit("AMRWMCSYRSGKWYKT"), base_code(a) * 4 + base_code(b) + 1, F.lit(1))


def trim_suffix_length(alleles: Column) -> Column:
    """How many last bases all alleles share, leaving each at least one base."""
    shortest = F.array_min(F.transform(alleles, lambda a: F.length(a)))
    first = F.element_at(alleles, 1)
    shared = F.filter(
        F.when(shortest > 1, F.sequence(F.lit(1), shortest - 1)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda k: F.forall(alleles, lambda a: F.right(a, k) == F.right(first, k)),
    )
    return F.coalesce(F.array_max(shared), F.lit(0))


def trim_suffix(alleles: Column) -> Column:
    n = trim_suffix_length(alleles)
    return F.transform(alleles, lambda a: F.substr(a, F.lit(1), F.length(a) - n))
