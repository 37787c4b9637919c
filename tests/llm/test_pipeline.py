import re
import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from genoframe.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, prose(20)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        t = prose(int(rng.integers(30, 120)))
        if i % 6 == 0:
            t += " stupid idiot worthless " + prose(3)
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i % 7 == 1:
            t += f" write to u{i}@mail.com now"
        if i % 50 == 2:
            t = items[i // 50 % 5][1] + " " + prose(5)
        rows.append([i, t])
    rows += [[1000, rows[1][1]], [1001, rows[1][1]], [1002, None], [1003, ""], [None, prose(40)]]
    long = prose(9000)
    rows += [[1004, long], [1005, long.replace(" ", "  ", 1)]]
    d = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, labels, items


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def test_stages_against_brute_force(spark, tables):
    d, rows, labels, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, d)
        if name != "packing":
            assert docs.columns == columns
        docs = docs.cache()
        at[name] = docs.collect()
    known = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    bad = {i for i, t in rows if t and " stupid idiot worthless " in t}
    left = {r.doc_id for r in at["toxicity"]}
    assert known and left == {i for i, _ in rows} - bad
    kept = [(i, t) for i, t in rows if i in left]
    named = {i: fingerprint(t) for i, t in kept if i is not None}
    label = {i: i for i in named}
    while True:
        before = dict(label)
        for i, a in named.items():
            for j, b in named.items():
                if (a ^ b).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
        if before == label:
            break
    single = {i for i in label if label[i] == i} | {None}
    assert {r.doc_id for r in at["near_dedup"]} == single and len(at["near_dedup"]) == len(single)
    grams = {tuple(w[k : k + 13]) for _, t in items for w in [words(t)] for k in range(len(w) - 12)}

    def contaminated(t):
        w = words(t)
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for p in range(k, k + 13)}
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    clean = {r.doc_id for r in at["near_dedup"] if not contaminated(r.text)}
    assert {r.doc_id for r in at["decontamination"]} == clean != single
    before = {r.doc_id: r.text for r in at["decontamination"]}
    for r in at["personal_data"]:
        assert r.text == (re.sub(r"u\d+@mail\.com", "[EMAIL]", before[r.doc_id]) if before[r.doc_id] else before[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert len(at["personal_data"]) == len(before)
    assert {r.doc_id for r in at["packing"]} == clean


def test_run(spark, tables):
    d, *_ = tables
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 150


def test_near_dedup_is_the_same_whatever_its_filter_lets_pass(spark, tables, monkeypatch):
    from genoframe.llm import common

    d = tables[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wide = cp.near_dedup(spark, docs, d).collect()
    monkeypatch.setattr(common, "FILTER_BITS", 1)
    every = cp.near_dedup(spark, docs, d).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(wide) == key(every) and 0 < len(wide) < docs.count()
