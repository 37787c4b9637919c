import hashlib
import re

import numpy as np
from genoframe.llm.decontaminate import FMIndex, WaveletTree, contamination_report, find_contamination, suffix_order


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(text, items, window=13):
    w = words(text)
    hit, names = set(), set()
    for name, t in items:
        i = words(t)
        n = min(window, len(i))
        grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                names.add(str(name))
    return len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)


def corpus():
    rng = np.random.default_rng(2)
    vocabulary = ["Ab", "c", "éa", "dd", "E5", "f-g", "h"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, prose(int(rng.integers(0, 40)))) for k in range(30)] + [(30, None), (31, "one two three"), (32, "one two three"), (33, "?!")]
    docs = [(k, prose(int(rng.integers(0, 60)))) for k in range(60)]
    docs += [(100 + k, prose(9) + " " + (items[k][1] or "") + " " + prose(4)) for k in range(34)]
    docs += [(200, None), (201, ""), (None, items[3][1]), (None, "one TWO three one two three"), (None, None), (5, docs[5][1]), (6, "other text under a known id, one two three")]
    docs += [(300, prose(4000) + " " + items[4][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "map('a', 1) as spans")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(k), t or "", *slow(t, items)) for k, t in docs)
    for options in ({}, {"block_items": 7}, {"shard_words": 50}, {"block_items": 1, "shard_words": 500}):
        got = find_contamination(d, i, **options)
        assert got.columns == ["doc_id", "n_words", "spans", "items"]
        rows = got.collect()
        assert all(a["end"] < b["start"] for r in rows for a, b in zip(r.spans, r.spans[1:]))
        have = sorted((str(r.doc_id), r.n_words, sum(s["end"] - s["start"] for s in r.spans), r["items"]) for r in rows)
        assert have == sorted((k, n, h, names) for k, _, n, h, names, _ in want)
        report = contamination_report(got).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in report) == sorted((k, n, h, c) for k, _, n, h, _, c in want)


def test_items_without_id(spark):
    """They count as one item and have no name; an item called None is another."""
    d = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f a b"), (4, "x")], "doc_id long, text string")
    i = spark.createDataFrame([(None, "a b"), (None, "c d"), ("None", "e f"), (None, None)], "item_id string, text string")
    for options in ({}, {"block_items": 1}, {"block_chars": 3}):
        found = find_contamination(d, i, **options)
        assert {r.doc_id: r["items"] for r in found.collect()} == {1: [None], 2: [None], 3: ["None", None], 4: []}
        report = {r.doc_id: (r.n_items, r.items_sha256) for r in contamination_report(found).collect()}
        empty, named = (hashlib.sha256(x).hexdigest() for x in (b"", b"None"))
        assert report == {1: (1, empty), 2: (1, empty), 3: (2, named), 4: (0, empty)}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id string, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in find_contamination(d, i).collect()] == [(2, [], [])]
    assert find_contamination(d.limit(0), i).collect() == []


def test_index_parts():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 200):
        text = rng.integers(1, 4, n)
        whole = np.append(text, 0)
        assert suffix_order(whole).tolist() == sorted(range(n + 1), key=lambda k: whole[k:].tolist())
        tree = WaveletTree(text, 4)
        at = rng.integers(0, n + 1, 20)
        assert tree.rank(np.full(20, 2), at).tolist() == [int((text[:k] == 2).sum()) for k in at]
        index = FMIndex(text, 4, sample=3)
        for size in (1, 2, 5):
            rows = rng.integers(1, 4, (6, size))
            lo, hi = index.search(rows)
            for r, a, b in zip(rows, lo, hi):
                where = sorted(index.locate(np.arange(a, b)).tolist())
                assert where == [k for k in range(n - size + 1) if (text[k : k + size] == r).all()]
