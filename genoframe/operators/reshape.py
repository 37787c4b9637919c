"""Splitting, joining, trimming and left-aligning of alleles.

Whatever changes a record's alleles is one step: ``src``, for each allele of the new
record its number in the old one (0 for REF, null if it is new). Genotypes and vectors
follow from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.genetics import genotype_index, let, trim_suffix
from genoframe.functions.keys import site_key


def renumber(values: Column, src: Column, number: str, n_old: Column) -> Column:
    """A vector of the old record in order of the new alleles; null where an allele is new.

    ``number``: ``A`` a value for each ALT, ``R`` for each allele, ``G`` for each
    genotype: diploid ones, or haploid ones where there are as many values as the old
    record has alleles (``n_old``).
    """
    if number == "A":
        return F.transform(F.slice(src, 2, F.size(src)), lambda o: F.get(values, o - 1))
    if number == "R":
        return F.transform(src, lambda o: F.get(values, o))
    pairs = F.flatten(
        F.transform(
            src,
            lambda y, j: F.transform(
                F.slice(src, 1, j + 1), lambda x: F.when(x.isNotNull() & y.isNotNull(), F.get(values, genotype_index(x, y)))
            ),
        )
    )
    return F.when((F.size(values) == n_old) & (n_old > 1), F.transform(src, lambda o: F.get(values, o))).otherwise(pairs)


def recode(allele: Column, src: Column, absent: int | None = None) -> Column:
    """The new number of an old allele; ``absent`` if it is gone, null stays null."""
    place = F.array_position(src, allele).cast("int")
    return F.when(allele.isNotNull(), F.when(place > 0, place - 1).otherwise(F.lit(absent).cast("int")))


def recoded_samples(samples: Column, src: Column, absent: int | None = None, *, fields: list[str] = ("a", "b"), vectors: dict[str, str] = {}, n_old: Column | None = None) -> Column:  # noqa: B006
    """Samples with the allele numbers of the new record: those of ``a`` and ``b``, or of the array ``gt`` where ``fields`` has it.

    ``vectors``: field -> A, R or G; each sample's vector is renumbered like a record's.
    """

    def new(s: Column) -> Column:
        if "gt" in fields:
            s = s.withField("gt", F.transform(s["gt"], lambda a: recode(a, src, absent)))
        else:
            s = s.withField("a", recode(s["a"], src, absent)).withField("b", recode(s["b"], src, absent))
        for c, number in vectors.items():
            s = s.withField(c, F.when(s[c].isNotNull(), renumber(s[c], src, number, n_old)))
        return s

    return F.transform(samples, new)


def take_alleles(sites: DataFrame, src: Column, vectors: dict[str, str], absent: int | None = None) -> DataFrame:
    """The record with the alleles ``src`` (REF first) of its own: ALTs, ``vectors`` (column -> A, R or G) and ``samples``."""
    sites = sites.withColumns({"_src": src, "_n": F.size("alts") + 1})
    out = {"alts": F.transform(F.slice("_src", 2, F.size("_src")), lambda o: F.get("alts", o - 1))}
    out |= {c: renumber(F.col(c), F.col("_src"), number, F.col("_n")) for c, number in vectors.items()}
    if "samples" in sites.columns:
        out["samples"] = recoded_samples(F.col("samples"), F.col("_src"), absent)
    return sites.withColumns(out).drop("_src", "_n")


def trim_unused(sites: DataFrame, counts: Column, vectors: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Records without the ALTs whose allele count is 0; genotypes and vectors follow."""
    used = F.filter(F.sequence(F.lit(0), F.size("alts")), lambda k: (k == 0) | (F.get(counts, k - 1) > 0))
    return take_alleles(sites, used, vectors)


def split_alleles(sites: DataFrame, per_alt: list[str] = (), per_allele: list[str] = (), per_genotype: list[str] = ()) -> DataFrame:
    """One row for each ALT: ``alts`` has it alone, ``nth`` is its number from 1.

    Arrays with a value for each ALT, each allele or each genotype (diploid or haploid)
    keep what belongs to the reference and this ALT, of any type; in ``samples`` other
    ALTs become the reference. The id is not carried over.
    """
    long = sites.filter(F.size("alts") > 0).withColumn("nth", F.explode(F.sequence(F.lit(1), F.size("alts"))))
    if "id" in sites.columns:
        long = long.withColumn("id", F.when(F.size("alts") == 1, F.col("id")))
    vectors = {c: "A" for c in per_alt} | {c: "R" for c in per_allele} | {c: "G" for c in per_genotype}
    return take_alleles(long, F.array(F.lit(0), F.col("nth")), vectors, absent=0)


def split_genotype(allele: Column, nth: Column) -> Column:
    """1 for this ALT, 0 for the reference and other ALTs; missing stays."""
    return F.when(allele.isNotNull(), (allele == nth).cast("int"))


def join_alleles(sites: DataFrame, group: Column, vectors: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Rows of one (site, group) into one, in order of ``rec``: the longest REF, ALTs extended to it and without repeats.

    ``qual`` is that of the first row. ``vectors`` (column -> A, R or G) take each value
    from the first row that has one for the allele or genotype. In ``samples`` a place of
    a genotype is that of the first row with an ALT there, else the reference, else missing.
    """
    by = [*site_key(sites), "_g"]
    whole = gathered(sites.withColumn("_g", group), by, "rec")
    out = {"qual": F.get("rows", F.lit(0))["qual"], "n_rows": F.size("rows")}
    out |= {c: by_rule("first", renumbered(c, n)) for c, n in vectors.items()}
    if "samples" in sites.columns:
        rows = F.transform("rows", lambda r: recoded_samples(r["samples"], r["src"]))
        place = lambda k, x: (
            lambda codes: F.coalesce(F.get(F.filter(codes, lambda a: a > 0), F.lit(0)), F.get(F.array_compact(codes), F.lit(0)))
        )(F.transform(rows, lambda s: F.get(s, k)[x]))
        out["samples"] = F.transform(F.get(rows, F.lit(0)), lambda s, k: s.withField("a", place(k, "a")).withField("b", place(k, "b")))
    return whole.select(*by[:-1], "ref", "alts", *[v.alias(c) for c, v in out.items()])


def collected(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Records of a group as one row: ``rows`` in order. A group is what shares a site, so its size follows the number of files."""
    rest = [c for c in rows.columns if c not in (*by, order)]
    whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("_x")))).alias("rows"))
    return whole.withColumn("rows", F.transform("rows", lambda r: r["_x"]))


def gathered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Records of a group as one row with their alleles united, see :func:`united_alleles`."""
    return united_alleles(collected(rows, by, order))


def united_alleles(whole: DataFrame, among: str = "rows") -> DataFrame:
    """Adds ``ref`` and ``alts`` of all ``rows``, and to each of them ``src``.

    The longest REF is taken, shorter records' alleles are extended by what theirs lacks
    (symbolic ones stay), and ALTs are gathered without repeats in order of the records
    of ``among``, which are these rows or more. ``src`` has, for each allele of the
    result, the record's own allele number or null.
    """
    ref = F.aggregate(among, F.lit(""), lambda acc, r: F.when(F.length(r["ref"]) > F.length(acc), r["ref"]).otherwise(acc))
    whole = whole.withColumn("ref", ref)
    longer = lambda r: F.transform(
        r["alts"], lambda a: F.when(a.rlike(r"[<>\[\]*]"), a).otherwise(F.concat(a, F.substr("ref", F.length(r["ref"]) + 1, F.length("ref"))))
    )
    alts = F.array_distinct(F.flatten("_ext"))
    if among != "rows":
        alts = F.array_intersect(F.array_distinct(F.flatten(F.transform(among, longer))), alts)
    whole = whole.withColumn("_ext", F.transform("rows", longer)).withColumn("alts", alts)
    place = lambda ext: F.concat(F.array(F.lit(0)), F.transform("alts", lambda a: F.nullif(F.array_position(ext, a).cast("int"), F.lit(0))))
    return whole.withColumn("rows", F.zip_with("rows", "_ext", lambda r, ext: r.withField("src", place(ext)))).drop("_ext")


def renumbered(column: str, number: str) -> Column:
    """A vector of every record of a group (see :func:`gathered`) in order of the group's alleles; null where a record lacks it."""
    return F.transform("rows", lambda r: F.when(r[column].isNotNull(), renumber(r[column], r["src"], number, F.size(r["alts"]) + 1)))


def by_rule(rule: str, arrays: Column) -> Column:
    """Arrays of the files, element by element: sum, avg, min, max, what comes first (``first``) or last (``last``).

    Missing counts as 0 in sums and averages; an average is over the files that have the tag.
    """

    def one(have: Column, j: Column) -> Column:
        values = F.transform(have, lambda v: F.get(v, j))
        if rule in ("sum", "avg"):
            total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
            return total if rule == "sum" else total / F.size(have)
        if rule in ("min", "max"):
            return F.array_min(values) if rule == "min" else F.array_max(values)
        known = F.array_compact(values)
        return {"first": F.get(known, F.lit(0)), "last": F.get(known, F.size(known) - 1)}[rule]

    def whole(have: Column) -> Column:
        width = F.array_max(F.transform(have, lambda v: F.size(v)))
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: one(have, j)))

    return let(F.filter(arrays, lambda v: v.isNotNull()), whole)


def trim(ref: Column, alts: Column) -> Column:
    """All alleles (REF first) without the bases that all end in."""
    return trim_suffix(F.concat(F.array(ref), alts))


def check_ref(sites: DataFrame, reference: DataFrame, policy: str = "warn", *, window: int = 1000) -> DataFrame:
    """REF against the reference (``chrom``, ``chunk``, ``seq``; chunks of ``window`` bases from 0).

    ``warn`` adds ``ref_ok`` (null where the reference has no such bases); ``exclude``
    drops records whose REF differs; ``fix`` sets REF, swapping with the ALT that equals
    the reference where there is one (``samples`` follow) ; ``stop`` fails on the first.
    """
    if policy not in ("warn", "exclude", "fix", "stop"):
        raise ValueError(policy)
    chunk = F.floor((F.col("pos") - 1) / window)
    here = reference.select("chrom", F.col("chunk").alias("_chunk"), F.col("seq").alias("_here"))
    after = reference.select("chrom", (F.col("chunk") - 1).alias("_chunk"), F.col("seq").alias("_after"))
    rows = sites.withColumn("_chunk", chunk).join(here, ["chrom", "_chunk"], "left").join(after, ["chrom", "_chunk"], "left")
    seen = F.substr(F.concat("_here", F.coalesce("_after", F.lit(""))), (F.col("pos") - F.col("_chunk") * window).cast("int"), F.length("ref"))
    rows = rows.withColumn("_seen", F.when(F.length(seen) == F.length("ref"), seen)).drop("_chunk", "_here", "_after")
    ok = F.upper("ref") == F.upper("_seen")
    if policy == "warn":
        return rows.withColumn("ref_ok", ok).drop("_seen")
    if policy == "exclude":
        return rows.filter(F.coalesce(ok, F.lit(True))).drop("_seen")
    if policy == "stop":
        message = F.concat(F.lit("REF differs at "), F.col("chrom").cast("string"), F.lit(":"), F.col("pos").cast("string"))
        return rows.filter(F.coalesce(ok, F.lit(True)) | F.raise_error(message).cast("boolean")).drop("_seen")
    k = F.array_position("alts", F.col("_seen")).cast("int")
    swap = ~F.coalesce(ok, F.lit(True)) & (k > 0)
    src = F.when(swap, F.concat(F.array(k), F.transform(F.sequence(F.lit(1), F.size("alts")), lambda j: F.when(j == k, 0).otherwise(j))))
    rows = rows.withColumns({"_fix": ~F.coalesce(ok, F.lit(True)), "_src": src, "_old": F.col("ref")})
    turned = F.transform("alts", lambda a, i: F.when(F.get("_src", i + 1) == 0, F.col("_old")).otherwise(a))
    out = {"ref": F.when(F.col("_fix"), F.col("_seen")).otherwise(F.col("ref")), "alts": F.when(F.col("_src").isNotNull(), turned).otherwise(F.col("alts"))}
    if "samples" in rows.columns:
        out["samples"] = F.when(F.col("_src").isNotNull(), recoded_samples(F.col("samples"), F.col("_src"))).otherwise(F.col("samples"))
    return rows.withColumns(out).drop("_fix", "_src", "_old", "_seen")


def remove_duplicates(sites: DataFrame, *, kind: str = "mask", order: str = "rec") -> DataFrame:
    """The first record, by ``order``, of each site and ``kind``."""
    w = Window.partitionBy(*site_key(sites), kind).orderBy(order)
    return sites.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def concat_files(files: list[DataFrame], *, samples: list[list[str]] | None = None, allow_overlap: bool = True) -> DataFrame:
    """All records of all files, ``file`` telling from which; files must have the same samples in order.

    Without ``allow_overlap`` files must follow each other: a contig's positions in one
    file may not begin before those of the file before it end.
    """
    if samples and any(s != samples[0] for s in samples):
        raise ValueError("files have different samples")
    whole = files[0].withColumn("file", F.lit(0))
    for k, f in enumerate(files[1:], 1):
        whole = whole.unionByName(f.withColumn("file", F.lit(k)))
    if not allow_overlap:
        ends = whole.groupBy("chrom", "file").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))  # a row for each contig and file
        before = F.max("hi").over(Window.partitionBy("chrom").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        if not ends.withColumn("before", before).filter("lo < before").isEmpty():
            raise ValueError("files overlap")
    return whole


def left_align(sites: DataFrame, reference: DataFrame, *, window: int = 1000) -> DataFrame:
    """(rec, pos, ref, alts) with indels moved as far left as the reference allows, within ``window`` bases.

    ``reference``: (chrom, chunk, seq), chunks of ``window`` bases numbered from 0. Each
    site is joined with its own chunk and the one before, so no task holds a contig.
    Repeated rows give repeated rows; rows without ALT stay.
    """
    size = window
    own = sites.withColumn("_chunk", F.floor((F.col("pos") - 1) / size))
    before = reference.select("chrom", (F.col("chunk") + 1).alias("_chunk"), F.col("seq").alias("_before"))
    here = reference.select("chrom", F.col("chunk").alias("_chunk"), F.col("seq").alias("_here"))
    rows = own.join(here, ["chrom", "_chunk"], "left").join(before, ["chrom", "_chunk"], "left")
    rows = rows.select("chrom", "rec", F.col("pos").cast("long").alias("pos"), "ref", "alts", F.col("_chunk").cast("long").alias("_chunk"), "_before", "_here")

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            moved = [
                _shift(p, r, list(a), (before or "") + (here or ""), c * size - len(before or ""))
                for p, r, a, c, before, here in zip(b["pos"], b["ref"], b["alts"], b["_chunk"], b["_before"], b["_here"])
            ]
            yield b[["chrom", "rec"]].assign(pos=[m[0] for m in moved], ref=[m[1] for m in moved], alts=[m[2] for m in moved])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(move, f"chrom {kinds['chrom']}, rec {kinds['rec']}, pos long, ref string, alts array<string>")


def _shift(pos: int, ref: str, alts: list[str], seq: str, offset: int) -> tuple[int, str, list[str]]:
    """One site: ``seq`` holds the bases of positions ``offset + 1`` and on."""
    alleles = [ref, *alts]
    if len(alleles) == 1 or len({len(a) for a in alleles}) == 1:
        return pos, ref, alts
    while len({a[-1:] for a in alleles}) == 1 and alleles[0]:
        if min(map(len, alleles)) == 1:
            at = pos - 1 - offset - 1
            if at < 0 or at >= len(seq):
                break
            alleles, pos = [seq[at] + a for a in alleles], pos - 1
        alleles = [a[:-1] for a in alleles]
    while min(map(len, alleles)) > 1 and len({a[0] for a in alleles}) == 1:
        alleles, pos = [a[1:] for a in alleles], pos + 1
    return pos, alleles[0], alleles[1:]
