"""The audit of filters against a walk through every order for every document."""

import random
import re
from itertools import permutations

from genoframe.llm.filter_audit import flagged_documents, interaction_audit, with_labels, word_totals
from pyspark.sql import functions as F

KINDS = "doc_id long, text string, lang string"


def fails(rows, k):
    doc_id, text, _ = rows[k]
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    same = [d for d, t, _ in rows if (t or "") == text and d is not None]
    smaller = any(d < doc_id for d in same) if doc_id is not None else bool(same)
    found = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
    return {c for c, f in zip("ABCDE", found) if f}


def plain(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    docs = [(r[0], r[2] or "", fails(rows, k)) for k, r in enumerate(rows)]
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        shapley = {c: 0 for c in "ABCDE"}
        for o in permutations("ABCDE"):
            left = own
            for s, c in enumerate(o, 1):
                gone = [x for x in left if c in x[1]]
                failing = [x for x in own if c in x[1]]
                out[part, "".join(o), s] = [len(left) - len(gone), len(gone), len(failing) - len(gone), sum(x[1] == {c} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                shapley[c] += len(gone)
                left = [x for x in left if c not in x[1]]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, KINDS).withColumns({"key": F.lit("k"), "part": F.lit(1), "word": F.lit("w"), "n": F.lit(2)}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    found = interaction_audit(with_labels(flagged_documents(docs), marks), list("ABCDE"), ["good", "toxic"])
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def test_equals_a_walk_through_all_orders(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["a", "b", "XY", "c$", "É", "\x1c"]) + str(rng.randint(0, rng.choice([3, 500]))) for _ in range(rng.choice([0, 20, 99, 100, 300]))), rng.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(60 + k, rows[k % 5][1], "en") for k in range(20)]  # copies
    rows += [(5, rows[5][1], "en"), (5, rows[5][1], "en"), (5, "another\ttext", "de"), (None, rows[7][1], "en"), (None, "alone", None), (None, None, "en"), (90, None, "en"), (91, "", None)]
    rows += [(92, " \t\r\n", "en"), (93, "w " * 20000, "en"), (94, "A" * 10 + "b" * 90, "fr"), (95, "x" * 5000, "fr")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 100, 3)] + [(3, None, 1), (None, 1, 1), (6, 1, None), (6, 0, None), (999, 1, 1)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    found = audited(spark, [(1, "one text", "en")], [])
    assert len(found) == 600 and found["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_words_are_not_shuffled(spark):
    docs = spark.createDataFrame([(b"k", "a b a")], "key binary, text string")
    plan = word_totals(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [tuple(r)[1:] for r in word_totals(docs.union(docs)).collect()] == [(2, 3, 2)]
