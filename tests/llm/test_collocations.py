"""Collocations against plain counting, with small shards and ranges so that tries are cut everywhere."""

import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from genoframe.llm.collocations import collocations, frequent_phrases, lift, restored, serialised
from pyspark.sql import functions as F

np = pytest.importorskip("numpy")


def plain(rows, least, most):
    """{lang: ranked rows} by the words of the contract."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, all_f in f.items():
        often = {p: a for p, a in all_f.items() if a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and 100 * inside[p] < 100 * a:
                cuts = [(1000 * a * n[lang] // (all_f[p[:k]] * all_f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), all_f[p[:k]], all_f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def drawn(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c\x01", "é", "de", "Zz", "of", "the", " x", "ß"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", " ; "]
    passage = "the quick of de a B c"
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 4, 30, 200])))
        rows.append((text + (passage if rng.random() < 0.3 else ""), rng.choice(["en", "fr", None, ""])))
    return rows


@pytest.mark.parametrize("seed, shard_words, range_chars", [(1, 40, 200), (2, 1000, 90), (3, 1 << 20, 10**6), (4, 7, 30)])
def test_equals_plain_counts(spark, seed, shard_words, range_chars):
    rows = drawn(seed, 120) + [(None, "en"), ("", None), ("   ", "fr"), ("same same same", "xx")] + [("one two three four five six", "yy")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"m": F.lit(1), "phrase": F.lit("x"), "a b.c": F.lit(2)}).repartition(5)
    got = collocations(docs, least=5, most=60, shard_words=shard_words, range_chars=range_chars).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 5, 60)


def test_one_long_text_and_repeats(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice("abcde") for _ in range(20000))
    rows = [(long, "en")] + [("x y z", "en")] * 300
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations(docs, shard_words=500, range_chars=4000).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 100, 2000)


def test_nodes_above_cuts_are_whole(spark):
    docs = spark.createDataFrame([(" ".join(["p q r s t"] * 40), "en")] * 3, "text string, lang string")
    nodes = frequent_phrases(docs, 1, shard_words=11, range_chars=20).filter("m > 0")
    assert nodes.count() == nodes.select("phrase").distinct().count()
    assert {r.phrase: r.f for r in nodes.filter("m = 1").collect()} == dict.fromkeys("pqrst", 120)


def test_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations(docs).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], docs.schema)).count() == 0


def test_paths_survive_serialising():
    rng = np.random.default_rng(3)
    paths = np.unique(rng.integers(0, 4, (500, 5)), axis=0)
    counts = rng.integers(1, 1 << 40, len(paths))
    used, blob = serialised([paths[:, d] for d in range(5)], counts)
    columns, n = restored(blob)
    assert (np.stack([used[c] for c in columns], 1) == paths).all() and (n == counts).all()


def test_lift_is_exact(spark):
    rng = random.Random(5)
    rows = [[rng.randint(1, 10**k) for _ in range(4)] for k in (1, 3, 9, 12, 15) for _ in range(40)]
    rows = [(min(a, x, y), n + a, x, y) for a, n, x, y in rows]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", lift(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s"))
    for r in df.collect():
        assert r.s == 1000 * r.a * r.n // (r.l * r.r) and not isinstance(r.s, Decimal)
