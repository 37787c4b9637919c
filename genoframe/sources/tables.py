"""Side tables from text files: regions, pedigrees, genetic maps, reference sequences, SNP tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.genetics import reverse_complement


def _cells(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Rows of fields; blank lines and lines that begin with ``#`` are left out."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.split(F.trim("value"), separator).alias("c"))


def _cell(n: int) -> Column:
    return F.get("c", F.lit(n))


def read_regions(spark: SparkSession, path: str, kind: str = "tab") -> DataFrame:
    """(chrom, from1, to1), 1-based and inclusive.

    ``tab``: chromosome, begin and end, 1-based; without an end a single position.
    ``bed``: begin counts from 0 and end is exclusive. ``vcf``: the span of each record.
    """
    begin = _cell(1).cast("long")
    if kind == "vcf":
        end = begin + F.length(_cell(3)) - 1
    elif kind == "bed":
        begin, end = begin + 1, F.coalesce(_cell(2).cast("long"), begin + 1)
    else:
        end = F.coalesce(_cell(2).try_cast("long"), begin)
    return _cells(spark, path).select(_cell(0).alias("chrom"), begin.alias("from1"), end.alias("to1"))


def read_target_alleles(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, alleles): targets with alleles, REF first, in a third column."""
    return _cells(spark, path).select(_cell(0).alias("chrom"), _cell(1).cast("long").alias("pos"), F.split(_cell(2), ",").alias("alleles"))


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(family, sample, father, mother, sex): lines of five fields or more; parents ``0`` are null, other sexes than 1 and 2 too."""
    named = lambda n: F.nullif(_cell(n), F.lit("0"))
    rows = _cells(spark, path).filter(F.size("c") >= 5)
    sex = F.when(_cell(4).isin("1", "2"), _cell(4).cast("int"))
    return rows.select(_cell(0).alias("family"), _cell(1).alias("sample"), named(2).alias("father"), named(3).alias("mother"), sex.alias("sex"))


def trios(pedigree: DataFrame) -> DataFrame:
    """(family, father, mother, child) of samples both of whose parents are named."""
    return pedigree.filter("father is not null and mother is not null").select("family", "father", "mother", F.col("sample").alias("child"))


def read_genetic_map(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """(chrom, pos, cm) of a file with a heading line and position, rate and centimorgans on each other line."""
    rows = _cells(spark, path).filter(_cell(0).rlike("^[0-9]+$"))
    return rows.select(F.lit(chrom).alias("chrom"), _cell(0).cast("long").alias("pos"), _cell(2).cast("double").alias("cm"))


def read_fasta(spark: SparkSession, path: str, *, chunk: int = 1000) -> DataFrame:
    """(chrom, chunk, seq): each contig in chunks of ``chunk`` bases, numbered from 0, upper case.

    A contig is one record of the reader; what follows is in chunks.
    """
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    seq = F.upper(F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s+", ""))
    rows = rows.select(F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("chrom"), seq.alias("seq")).filter(F.length("seq") > 0)
    last = F.floor((F.length("seq") - 1) / chunk).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk"), F.substr("seq", k * chunk + 1, F.lit(chunk)).alias("seq")))
    return rows.select("chrom", F.explode(cut).alias("x")).select("chrom", "x.chunk", "x.seq")


def sites_of_snp_table(rows: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alts) from a table (chrom, start, name, strand, ref, observed).

    ``start`` counts from 0; ``observed`` has alleles parted by ``/``, given for the
    strand. Insertions and deletions (an allele ``-``) stand on the base before, which
    the table does not have: ``N``. Observed alleles equal to the reference are no ALTs;
    rows without any other are left out.
    """
    turned = F.transform(F.split("observed", "/"), lambda a: F.when((F.col("strand") == "-") & (a != "-"), reverse_complement(a)).otherwise(a))
    gap = F.exists(F.concat(F.array("ref"), turned), lambda a: a == "-")
    shown = lambda a: F.when(gap, F.concat(F.lit("N"), F.regexp_replace(a, "-", ""))).otherwise(a)
    alts = F.transform(F.array_distinct(F.filter(turned, lambda a: a != F.col("ref"))), shown)
    pos = F.when(gap, F.col("start")).otherwise(F.col("start") + 1)
    out = rows.withColumns({"_pos": pos.cast("long"), "_alts": alts, "_ref": shown(F.col("ref"))}).filter(F.size("_alts") > 0)
    return out.select("chrom", F.col("_pos").alias("pos"), F.col("name").alias("id"), F.col("_ref").alias("ref"), F.col("_alts").alias("alts"))


def genotypes_of_hapmap(rows: DataFrame, snps: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, id, ref, alts, samples) of a genotype table (id, observed, strand, calls) by a SNP table.

    ``snps``: as for :func:`sites_of_snp_table`, of which single bases count; ``calls``: an
    array of two letters for each of ``samples``, ``NN`` where there is none. Alleles and
    calls are turned to the reference's strand where only their complement has its base.
    Rows whose id is unknown, that have not two single bases, or neither of whose strands
    has the reference's base are left out.
    """
    known = snps.filter(F.length("ref") == 1).select("chrom", (F.col("start") + 1).cast("long").alias("pos"), F.col("name").alias("id"), F.upper("ref").alias("ref")).dropDuplicates(["id"])
    both = rows.select("id", F.split("observed", "/").alias("_a"), "calls").filter((F.size("_a") == 2) & F.forall("_a", lambda a: F.length(a) == 1)).join(known, "id")
    turn = ~F.array_contains("_a", F.col("ref"))
    letter = lambda c: F.when(F.col("_turn"), F.translate(c, "ACGT", "TGCA")).otherwise(c)
    both = both.withColumn("_turn", turn).withColumn("_a", F.transform("_a", letter)).filter(F.array_contains("_a", F.col("ref")))
    both = both.withColumn("alts", F.array_remove("_a", F.col("ref")))
    code = lambda c: F.when(c == F.col("ref"), 0).when(c == F.get("alts", F.lit(0)), 1)
    names = F.array(*[F.lit(s) for s in samples])
    calls = F.zip_with(
        names, "calls", lambda s, c: F.struct(s.alias("sample"), code(letter(F.substr(c, F.lit(1), F.lit(1)))).alias("a"), code(letter(F.substr(c, F.lit(2), F.lit(1)))).alias("b"))
    )
    return both.filter(F.size("alts") == 1).select("chrom", "pos", "id", "ref", "alts", calls.alias("samples"))


def read_hapmap(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(samples, rows with id, observed, strand, calls) of a text table whose heading begins with ``rs#`` and has samples from its twelfth column."""
    lines = spark.read.text(path)
    heading = lines.filter(F.col("value").startswith("rs#")).first()
    samples = heading["value"].split()[11:] if heading else []
    cells = lines.filter(~F.col("value").startswith("rs#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("c"))
    return samples, cells.select(_cell(0).alias("id"), _cell(1).alias("observed"), _cell(4).alias("strand"), F.slice("c", 12, max(1, len(samples))).alias("calls"))


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample, ploidy): a name on each line and, where given, its ploidy 0, 1 or 2; 2 otherwise. Others are an error."""
    ploidy = F.coalesce(_cell(1), F.lit("2"))
    checked = F.when(ploidy.isin("0", "1", "2"), ploidy.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no ploidy: "), ploidy)).cast("int"))
    return _cells(spark, path).select(_cell(0).alias("sample"), checked.alias("ploidy"))


def sex_ploidy(pedigree: DataFrame, chrom: str) -> DataFrame:
    """(sample, ploidy) on a chromosome: X is single in males (sex 1), Y single in males and absent in females, all else double."""
    male, name = F.coalesce(F.col("sex") == 1, F.lit(False)), chrom.removeprefix("chr")
    copies = {"X": F.when(male, 1).otherwise(2), "Y": F.when(male, 1).otherwise(0)}.get(name, F.lit(2))
    return pedigree.select("sample", copies.cast("int").alias("ploidy"))


def read_genetic_maps(spark: SparkSession, mask: str, chroms: list[str]) -> DataFrame:
    """(chrom, pos, cm) of one file for each contig, ``{CHROM}`` in the mask standing for its name; a contig without a file is passed over.

    A file must begin with the heading ``position COMBINED_rate(cM/Mb) Genetic_Map(cM)``.
    """
    out = spark.createDataFrame([], "chrom string, pos long, cm double")
    for chrom in chroms:  # a file for each contig
        path = mask.replace("{CHROM}", chrom)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            continue
        heading = spark.read.text(path).first()
        if heading is None or heading["value"].split() != ["position", "COMBINED_rate(cM/Mb)", "Genetic_Map(cM)"]:
            raise ValueError(f"no genetic map: {path}")
        out = out.unionByName(read_genetic_map(spark, path, chrom))
    return out
