"""How filters on documents interact: what each removes, repeats and alone finds, in every order.

Words are a relation: texts are dealt by document, exploded into words, counted by
(document, word) and then by document. The other flags meet those totals in an outer
join, and one pass counts the documents of each part by the set of filters that they
fail: two to the power of the filters' number of conditional counts. All orders follow
from these counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import cut

#: Maximal runs of anything else are words.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of the input to a task that counts words, and the most such tasks.
TASK_BYTES, MOST_TASKS = 4 << 20, 1 << 16
#: The optimizer's estimate of what it cannot know is of this order.
_UNKNOWN = 1 << 56


def document_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a document: its id, null apart from all others, and its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit(":"), text)))


def tasks_for(docs: DataFrame) -> int:
    """Tasks of about ``TASK_BYTES`` of the input by the optimizer's estimate, which is the files' size for a table.

    Where it knows no size (rows that come from no file) the session's number of shuffle partitions.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= _UNKNOWN else min(MOST_TASKS, max(least, size // TASK_BYTES))


def word_totals(docs: DataFrame) -> DataFrame:
    """(key, copies, words, distinct) of ``docs`` (key, text): rows of one key, words of one of them, distinct words.

    Texts are dealt by key once; both counts follow that partitioning, so words are not
    shuffled. Each text gives one empty word more, which counts the rows of a key.
    """
    dealt = docs.select("key", "text").repartition(tasks_for(docs), "key")
    each = F.concat(F.array(F.lit("")), F.array_remove(F.split("text", SPACE), ""))
    counted = dealt.select("key", F.explode(each).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    totals = counted.groupBy("key").agg(F.sum(F.when(~real, F.col("n"))).alias("copies"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("n"), F.count_if(real).alias("distinct"))
    return totals.select("key", "copies", F.expr("n div copies").alias("words"), "distinct")


def flagged_documents(docs: DataFrame, *, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, signs: str = "[#$%&*|]") -> DataFrame:
    """(doc_id, part, A, B, C, D, E): a row for each row of ``docs`` (doc_id, text, lang), true where it fails.

    A: fewer words than ``least_words``; B: distinct words under ``distinct_percent`` of
    them; C: capitals A to Z over ``capital_percent`` of the code points; D: one of
    ``signs``; E: some smaller doc_id has the same text. A null text is the empty one, a
    null lang the part of the empty string. Rows without doc_id come after all others:
    they fail E if any row with one has their text. Rows equal in doc_id and text are
    documents each, none smaller than the other. No row gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), document_key(F.col("doc_id"), text).alias("key"))
    # Written once: what is left of a document is small, and it is read three times.
    facts = cut(
        rows.select(
            "doc_id",
            "part",
            "key",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            (100 * F.regexp_count("text", F.lit("[A-Z]")) > capital_percent * F.length("text")).alias("C"),
            F.col("text").rlike(signs).alias("D"),
        )
    )
    totals = cut(word_totals(rows))
    shared = facts.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    own = facts.join(totals, "key", "outer").join(shared, "digest", "left")
    return own.select(
        "doc_id",
        "part",
        (F.col("words") < least_words).alias("A"),
        (100 * F.col("distinct") < distinct_percent * F.col("words")).alias("B"),
        "C",
        "D",
        F.coalesce((F.col("doc_id") > F.col("_first")) | (F.col("doc_id").isNull() & F.col("_first").isNotNull()), F.lit(False)).alias("E"),
    )


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``: some label row of the doc_id has quality 1, toxic 1. Documents without label have neither."""
    by = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flagged.join(by, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def failure_counts(flagged: DataFrame, filters: list[str], also: list[str]) -> DataFrame:
    """(part, n, then a column for each of ``also``): arrays over the sets of failed filters, as bit masks.

    Each element is a conditional count of its own, so that all are summed before the
    shuffle and a part is one row of it for each task.
    """
    mask = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    rows = flagged.select("part", mask.alias("_mask"), *also)
    sets = range(1 << len(filters))
    counts = [F.count_if(F.col("_mask") == s).alias(f"n{s}") for s in sets]
    counts += [F.count_if((F.col("_mask") == s) & F.col(c)).alias(f"{c}{s}") for c in also for s in sets]
    return rows.groupBy("part").agg(*counts).select("part", *[F.array(*[F.col(f"{c}{s}") for s in sets]).alias(c) for c in ("n", *also)])


def interaction_audit(flagged: DataFrame, filters: list[str], also: list[str]) -> DataFrame:
    """A row for each part, order of all ``filters`` and step of the order.

    ``kept``: documents left after the step; ``removed``: those that it takes;
    ``redundant``: those that fail its filter but went before; ``unique_fails``: those
    that fail no other; ``<x>_lost`` for each boolean column of ``also``: removed
    documents that have it; ``shapley``: what the filter removes, summed over all orders.
    A document that fails m filters is removed by each of them in one m-th of the orders.
    """
    steps = [("".join(o), k + 1, 1 << filters.index(o[k]), sum(1 << filters.index(f) for f in o[:k])) for o in permutations(filters) for k in range(len(o))]
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("filter_order", "step", "bit", "before"), s)]) for s in steps])
    rows = failure_counts(flagged, filters, also).select("*", F.explode(listed).alias("s")).select("part", "n", *also, "s.*")
    sets, orders = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)), factorial(len(filters))
    total = lambda of, test, weight=lambda s: F.lit(1).cast("long"): F.aggregate(F.filter(sets, test), F.lit(0).cast("long"), lambda t, s: t + F.get(of, s) * weight(s))
    fails, gone = (lambda s: s.bitwiseAND(F.col("bit")) != 0), (lambda s: s.bitwiseAND(F.col("before")) != 0)
    here = lambda s: fails(s) & ~gone(s)
    share = lambda s: F.lit(orders) / F.bit_count(s)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda s: ~fails(s) & ~gone(s)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda s: fails(s) & gone(s)).alias("redundant"),
        F.get("n", "bit").alias("unique_fails"),
        *[total(c, here).alias(f"{c}_lost") for c in also],
        total("n", fails, lambda s: share(s).cast("long")).alias("shapley"),
    )
