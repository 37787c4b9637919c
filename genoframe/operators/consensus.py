"""Consensus sequences and the identity of samples from likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.keys import site_key
from genoframe.operators.calling import pl_to_prob


def consensus(bases: DataFrame, masks: DataFrame, *, size: int = 10_000) -> DataFrame:
    """(chrom, chunk, seq): the consensus in chunks of ``size`` positions, chunk k from position k * size.

    ``bases``: (chrom, pos, base, low), a letter for each called position, in lower case
    where ``low``; ``masks``: (chrom, from1, to1), positions whose letters become lower
    case too. What has no base is ``n``; chunks without any are left out. Of several
    bases at one position the last letter by alphabet is taken. Rows are dealt by chunk
    once, so no task holds a contig.
    """
    covered = masks.select("chrom", F.explode(F.sequence("from1", "to1")).alias("pos"), F.lit(None).cast("string").alias("base"), F.lit(True).alias("low"))
    rows = bases.select("chrom", "pos", "base", "low").unionByName(covered)
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / size)).repartition("chrom", "chunk")
    one = rows.groupBy("chrom", "chunk", "pos").agg(F.max("base").alias("base"), F.bool_or("low").alias("low")).filter("base is not null")
    at = (F.col("pos") - F.col("chunk") * size).cast("int")
    letter = F.when(F.col("low"), F.lower("base")).otherwise(F.col("base"))
    gathered = one.groupBy("chrom", "chunk").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), letter.alias("letter")))).alias("x"))
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("x", i - 1)["at"])
    parts = F.transform("x", lambda x, i: F.concat(F.repeat(F.lit("n"), x["at"] - before(i) - 1), x["letter"]))
    return gathered.select("chrom", "chunk", F.rpad(F.array_join(parts, ""), size, "n").alias("seq"))


def sample_likelihood(query: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """(sample, lk, sites, rescaled): how badly each sample's likelihoods fit the query's genotypes; the least fits best.

    ``query``: (site, dosage), the number of non-reference alleles; ``likelihoods``: (site,
    sample, pl). Sites without a likelihood or a genotype are left out. ``rescaled`` adds
    up, site by site, how far the sample is from the site's best on the scale from its best
    to its worst sample; sites where all are alike add nothing.
    """
    by = site_key(query, likelihoods)
    fits = F.get(pl_to_prob(F.col("pl")), F.col("dosage"))
    both = likelihoods.join(query.select(*by, F.col("dosage").cast("int").alias("dosage")), by).select(*by, "sample", (-F.ln(fits)).alias("s")).filter("s is not null")
    site = Window.partitionBy(*by)
    low, high = F.min("s").over(site), F.max("s").over(site)
    both = both.withColumn("r", F.coalesce((F.col("s") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))
    return both.groupBy("sample").agg(F.sum("s").alias("lk"), F.count("*").alias("sites"), F.sum("r").alias("rescaled"))
