import corpus_pipeline as cp
import numpy as np
from genoframe.llm import copies
from genoframe.llm.copies import copy_groups, odd_sketch, shingles, similarity


def slow_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def near_texts(rng):
    """Random texts, each with copies in which a few words are replaced."""
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    texts = []
    for n in [200] * 30 + [1000] * 6 + [40] * 30:
        w = list(rng.choice(vocabulary, n))
        texts.append(" ".join(w))
        for share in (0.004, 0.01, 0.018, 0.03):
            c = list(w)
            for k in rng.integers(0, n, max(1, round(share * n))):
                c[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(c))
    return texts


def groups(texts):
    sets = [slow_shingles(t) for t in texts]
    label = list(range(len(texts)))
    links = [(i, j, s) for j in range(len(sets)) for i in range(j) if (s := jaccard(sets[i], sets[j])) >= 0.8 or not (sets[i] or sets[j])]
    while True:
        before = list(label)
        for i, j, _ in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label, links


def test_shingles():
    for t in (None, "", " \n", "One", "a b c d e", "A b  c d e f g a b c d e f"):
        assert len(shingles(t)) == len(slow_shingles(t))
    assert similarity(shingles("a b c d e f"), shingles("A b c d e g")) == 1 / 3


def test_stage_keeps_no_near_copy(spark):
    texts = near_texts(np.random.default_rng(4)) + [None, "", "  ", "one two", "one  TWO"]
    label, links = groups(texts)
    assert sum(s < 0.9 for *_, s in links) > 20
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    left = {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()}
    assert left == set(label)


def test_dissimilar_texts_of_one_bucket_are_all_compared(spark):
    """At a high threshold, texts alike to each other but not to their bucket's leader still meet."""
    rng = np.random.default_rng(7)
    base = [str(x) for x in rng.integers(0, 10**6, 300)]
    texts = []
    for k in range(12):
        w = list(base)
        for at in rng.integers(0, 300, 4):
            w[at] = f"x{k}"
        texts += [" ".join(w), " ".join([*w, "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r["key"]: r["group"] for r in copy_groups(docs, least=0.99).collect()}
    assert len(got) == 24 and len(set(got.values())) == 12
    assert all(got[k] == got[k + 1] for k in range(0, 24, 2))
    assert copy_groups(docs.limit(0)).collect() == []


def test_odd_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 400, 9000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.append(a[: int(0.8 * n)], rng.integers(0, 2**64, n // 5, np.uint64)))
        bits = int(np.bitwise_count((odd_sketch(a) ^ odd_sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))
    assert not odd_sketch(shingles(None)).any()


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Many texts of one template, alike in pairs only, with one text repeated and one key given twice."""
    monkeypatch.setattr(copies, "SPLIT", 5)
    rng = np.random.default_rng(11)
    base = [str(x) for x in rng.integers(0, 10**6, 120)]
    texts = []
    for k in range(30):
        w = list(base)
        for at in rng.choice(120, 6, replace=False):
            w[at] = f"x{k}"
        texts += [" ".join(w), " ".join([*w, "end"])]
    texts += [texts[0]]
    rows = [*enumerate(texts), (3, texts[3])]
    label, links = groups([t for _, t in rows])
    assert len({label[k] for k in range(60)}) > 15
    got = {r["key"]: r["group"] for r in copy_groups(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert set(got) == set(range(60))
    for a in range(60):
        for b in range(a):
            assert (got[a] == got[b]) == (label[a] == label[b])


def test_components_leave_one_table(spark):
    import os

    from genoframe.llm.common import remove, shared_dir
    from genoframe.llm.components import connected_components

    links = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10 != 9], "u long, v long")
    here = shared_dir(spark).removeprefix("file:")
    before, made = set(os.listdir(here)) | {""}, []
    subs = {d: set(os.listdir(f"{here}/{d}")) for d in before if d and os.path.isdir(f"{here}/{d}")}
    out = connected_components(links, made)
    assert {(r.node, r.component) for r in out.collect()} == {(k, k // 10 * 10) for k in range(40)}
    fresh = [f"{here}/{d}" for d in set(os.listdir(here)) - before] + [f"{here}/{d}/{x}" for d, own in subs.items() if os.path.isdir(f"{here}/{d}") for x in set(os.listdir(f"{here}/{d}")) - own]
    assert fresh == [p.removeprefix("file:") for p in made] and len(made) == 1
    remove(spark, *made)


def test_filter_before_a_shuffle_loses_no_key(spark, monkeypatch):
    from genoframe.llm import common

    rows = spark.range(20_000).selectExpr("nullif(id, 7) as id", "struct(id % 3 = 0 as odd, nullif(id, 7) as id) as key")
    keys = rows.filter("id is null or id % 50 = 3").select("key")
    wanted = {r.id for r in rows.filter("id is null or id % 50 = 3").collect()}
    for bits, most in ((24, len(wanted) + 20), (6, 20_000)):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = common.possibly(rows, keys, "key")
        assert got.count() == 20_000
        passed = {r.id for r in got.filter("_possible").collect()}
        assert wanted <= passed and len(passed) <= most
    assert not common.possibly(rows, keys.limit(0), "key").filter("_possible").count()
