import hashlib
import struct

import numpy as np
import regex
import xxhash
from genoframe.llm.syncmers import SIZE, edited_fingerprints


def h(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<Q", v), seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def slow(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    wh = [h(w) for w in words]
    if not words:
        return []
    if len(words) < 6:
        found = [(h(" ".join(str(signed(x)) for x in wh)) >> 32, 0)]
    else:
        m = [h(*wh[i : i + 3]) for i in range(len(wh) - 2)]
        found = []
        for i in range(len(m) - 3):
            four = [signed(x) for x in m[i : i + 4]]
            if min(four) in (four[0], four[3]):
                found.append((h(m[i], m[i + 3]) >> 32, i))
    first = {}
    for x, i in sorted(found):
        first.setdefault(x, i)
    return sorted(first.items())[:SIZE]


def spelt(a):
    return " ".join(f"{x:08x}@{i}" for x, i in a)


def text(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), int(rng.integers(1, 7)))) for _ in range(n)) + "."


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = {i * 37: text(rng, int(rng.integers(0, 300))) for i in range(120)}
    texts |= {5: None, 6: "", 7: " .\n", 8: "One two 3", 9: "😀 One two, three four five six", 10: "a " * 40_000, 2_500_000: "far away text", -4: "below"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as a", "2 as next", "3 as _bucket")
    got = {r.doc_id: r for r in edited_fingerprints(df).collect()}
    assert set(got) == set(texts)
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == spelt(slow(own))
        assert r.edited_fingerprint == spelt(slow(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for i, r in got.items() if len(set((texts[i] or "").split())) > 60]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.05


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(3, "a b c d e f g h i")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c d e f a b c").hexdigest() and one.near_next == 1.0
    rows = [(1, "x y"), (1, "x y"), (None, "z"), (None, None)]
    many = edited_fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in many) == ["1", "1", "None", "None"]


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    pa, pb = dict(a), dict(b)
    least = sorted(set(pa) | set(pb))[:SIZE]
    shared = [x for x in least if x in pa and x in pb]
    if not shared:
        return 0.0
    shift = [pa[x] - pb[x] for x in shared]
    middle = sorted(shift)[len(shift) // 2]
    reach = max(32, max([*pa.values(), *pb.values()]) // 8)
    return sum(abs(x - middle) <= reach for x in shift) / len(least)


def with_least(text):
    """Like ``slow``; a text without closed syncmers has its k-mer of least hash."""
    found = slow(text)
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    if found or not words:
        return found
    wh = [h(w) for w in words]
    m = [h(*wh[i : i + 3]) for i in range(len(wh) - 2)]
    return [min((h(m[i], m[i + 3]) >> 32, i) for i in range(len(m) - 3))]


def test_likeness_and_short_texts_match_brute_force(spark):
    rng = np.random.default_rng(11)
    base = text(rng, 200)
    texts = {f"k{i * 37 % 101:03d}": text(rng, int(rng.integers(5, 10))) for i in range(80)}
    texts |= {f"n{i}": base if i % 2 else base + " " + text(rng, 30 * i) for i in range(6)} | {"": None, "z": " . "}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in edited_fingerprints(df, least=True).collect()}
    order = sorted(texts, reverse=True)
    bare = 0
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        a, e, n = with_least(own), with_least(edited), with_least(after)
        bare += slow(own) == [] and a != []
        assert got[i].fingerprint == spelt(a) and got[i].edited_fingerprint == spelt(e)
        assert got[i].near_edited == plain_likeness(a, e) and got[i].near_next == plain_likeness(a, n)
    assert bare > 5


def test_hot_and_sparse_ids(spark, monkeypatch):
    """Ids far apart, a third of the rows without id and a third of one id: the same order as by hand."""
    from genoframe.llm import syncmers

    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 4)
    rng = np.random.default_rng(12)
    ids = [*(int(x) for x in rng.integers(-(2**62), 2**62, 100)), *[None] * 100, *[7] * 100]
    rows = [(i, text(rng, 6) + f" {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = edited_fingerprints(df).collect()
    by_text = {t: h(t) for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(by_text[r[1]]), r[1].encode()), reverse=True)
    want = []
    for k, (i, own) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(own) // 3
        want.append((str(i), hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)
