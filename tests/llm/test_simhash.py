import re

import numpy as np
import xxhash
from genoframe.llm.simhash import GrayIndex, fingerprint, near_duplicates


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    ids = [i for i, _ in rows]
    label = dict(zip(ids, ids))
    pairs = [(i, j) for i, a in rows for j, b in rows if bin(a ^ b).count("1") <= 4]
    while True:
        before = dict(label)
        for i, j in pairs:
            label[i] = min(label[i], label[j])
        if before == label:
            return label


def words(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gämma", "delta", "eps", "zeta", "eta", "theta"], n))


def test_fingerprint_matches_plain_form():
    rng = np.random.default_rng(3)
    for text in [None, "", " \t\n", "One", "a b c d", "A b c", *(words(rng, n) for n in (3, 4, 5, 40, 300))]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [words(rng, 200) for _ in range(6)]
    texts = [None, "", "  ", "same", "same"]
    for b in base:
        for k in range(6):
            w = b.split()
            w[: k // 2] = ["changed"] * (k // 2)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + [rows[7]], "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as u")
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    for block in (16_384, 3):
        got = near_duplicates(df, block=block).collect()
        assert len(got) == len(rows) + 1
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.fingerprint % 2**64 == slow_fingerprint(texts[r.doc_id]) for r in got)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "x y"), (3, "x y")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(df).collect()) == [("3", "3"), ("None", "None")]


def test_index_finds_all_links():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 150))
        codes = rng.integers(0, 2**63, max(1, n // 4), np.uint64)[rng.integers(0, max(1, n // 4), n)]
        for _ in range(int(rng.integers(0, 7))):
            codes = codes ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        root = GrayIndex(codes, np.zeros(n, int)).components(4)
        want = slow_components(list(enumerate(codes.tolist())))
        lab = np.array([want[i] for i in range(n)])
        assert ((root[:, None] == root[None]) == (lab[:, None] == lab[None])).all()


def test_rows_without_id_join_others(spark, monkeypatch):
    from genoframe.llm import simhash

    codes = {1: 0, 2: 0b1111, None: 0b11111111, 3: 0b111111111111, 9: 1 << 40 | 0xFFF << 48}
    df = spark.createDataFrame([(i, c) for i, c in codes.items()], "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: df)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, None: None, 3: 1, 9: 9}


def test_large_keys_are_cut_by_their_size(spark):
    from genoframe.llm.simhash import near_links

    rng = np.random.default_rng(4)
    codes = sorted({int(c) for c in rng.integers(0, 1 << 10, 400)} | {int(c) << 40 for c in rng.integers(0, 1 << 9, 60)})
    want = slow_components([(c, c) for c in codes])
    df = spark.createDataFrame([(c,) for c in codes], "fingerprint long")
    for block in (2, 40):  # 2: more runs than cells, so cells are cut by hash
        label = {c: c for c in codes}
        links = [tuple(r) for r in near_links(df, block=block).distinct().collect()]
        while True:
            before = dict(label)
            for u, v in links:
                label[u] = label[v] = min(label[u], label[v])
            if before == label:
                break
        assert label == want
