"""The corpus pipeline: five stages over ``documents``, each by one of the corpus operators.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> packing.
Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Between stages the rows are written to the shared folder and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm.common import possibly, remove, scratch, table, written
from genoframe.llm.copies import copy_groups
from genoframe.llm.decontaminate import contamination_report, find_contamination
from genoframe.llm.packing import pack, token_pieces
from genoframe.llm.pii import find_pii, redact
from genoframe.llm.queries import tokenizer_path
from genoframe.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go; null and empty texts stay unless predicted so.

    Rows pass as one column beside their score, so a column named like it stays as it is.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return score_toxicity(rows, model).filter("predicted = 0").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Copies share 0.8 or more of their five-word shingles. Of rows of one doc_id with
    different texts each is a document of its own, and the least by a hash of the text
    goes first; rows without doc_id come last. Of rows equal in both, the one whose other
    columns come first as JSON stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.col("text").isNull().alias("none"))
    keyed = docs.select(key.alias("key"), "text")
    first = written(copy_groups(keyed).groupBy("group").agg(F.min("key").alias("key")).select("key"), "first")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).join(first.withColumn("stays", F.lit(True)), "key", "left")
    unsure = written(counts.filter("n > 1 or stays is null").select("key"), "unsure")  # only these are shuffled with their texts
    rows = possibly(docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key")), unsure, "key")
    rest = rows.filter("_possible").select("doc", "key", F.to_json(F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "text"])).alias("others"))
    rest = rest.join(first, "key", "left_semi").groupBy("key").agg(F.min_by("doc", "others").alias("doc"))
    return rows.filter("not _possible").select("doc.*").unionByName(rest.select("doc.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark windows go. Whole rows pass through the search, so nothing is shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    report = contamination_report(find_contamination(rows, table(spark, sf_dir, "benchmark")))
    return report.filter("not contaminated").select("doc_id.*").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows. No document goes."""
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    found = find_pii(rows).select("doc_id", redact(F.col("doc_id.text"), F.col("spans")).alias("clean"))
    made = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[made.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, tokenised and packed; a row for each piece."""
    return pack(token_pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, *last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
