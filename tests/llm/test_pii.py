import hashlib
import re

import numpy as np
import pytest
from genoframe.llm.pii import KINDS, classifier, estimate, find_pii, pii_report, redact
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def slow(text):
    out = []
    for n, k in enumerate(KINDS):
        for m in re.finditer(PATTERNS[k], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[k]()
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def noisy(rng):
    parts = [
        "a.b@c.de", "é@x.fr", "x@y", "1.2.3.4", "300.1.1.1", "000255.1.2.3", "1.2.3.4.5", "4539 1488 0343 6467", "4111111111111111", "4111-1111-1111-1112",
        "+1 (858) 555-1537", "+49", "+123456789012345678", "😀", "ñandú", " ", "\n", ".", "-", "7", "@", "call", "(212) 555-0187", "bob [at] corp [dot] com", "12",
        "_d@e.f", "+1 4111 1111 1111 1111",
    ]
    return "".join(p + str(rng.choice(["", " ", " ", "x"])) for p in rng.choice(parts, int(rng.integers(0, 14))))


def test_base_spans_match_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "a@b.c_d@e.f", "9" * 30_000, "1.1.1.1 " * 3000, *(noisy(rng) for _ in range(300))]
    df = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string").selectExpr("*", "1 as found", "2 as spans")
    found = find_pii(df)
    rows = pii_report(found).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = slow(texts[r.doc_id])
        assert [getattr(r, f"n_{k}") for k in KINDS] == [sum(n == j for _, n, _ in want) for j in range(4)]
        line = ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_redaction_and_empty(spark):
    df = spark.createDataFrame([(1, "mail é a@b.cd, or +1 (858) 555-1537."), (2, None)], "doc_id long, text string")
    got = find_pii(df).join(df, "doc_id").select("doc_id", redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {1: "mail é [EMAIL], or [PHONE].", 2: None}
    assert find_pii(df.limit(0)).count() == 0


def test_method_adds_cued_numbers(spark):
    rows = [f"please call me, tel: ({200 + i}) 555-{1000 + i} ok" for i in range(60)] + [f"order no. {i} came {i}.5" for i in range(60)]
    rows += [f"write to u{i}@mail.com or call +1 858 555 {1000 + i} now" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_report(find_pii(df)).collect()}
    assert sum("phone" in got[i] for i in range(60)) > 50
    assert all(got[i] == "" for i in range(60, 120))


def test_estimate_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, truth, ~truth).astype(int)
    fair = np.where(rng.random(4000) < 0.8, truth, ~truth).astype(int)
    noise = (rng.random(4000) < 0.5).astype(int)
    votes, n = np.unique(np.stack([good, fair, noise], 1), axis=0, return_counts=True)
    prior, chances, post = estimate([(v.tolist(), float(k)) for v, k in zip(votes, n)], 300)
    assert prior == pytest.approx(0.3, abs=0.1)
    assert chances[0][1][1] > chances[2][1][1] and len(post) == len(votes)
    assert estimate([]) == (0.5, [], [])
    assert classifier([(0, 1, 9.0, 1.0)])[0][1] != 0


def test_long_runs_take_linear_time(spark):
    import time

    texts = ["x" * 500_000 + "@", "1" * 500_000 + ".", "call 212 555 1234, " * 8000, "a.b@c.de" * 20_000, "😀" * 3000 + " tel 212 555 1234 or a@b.cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in pii_report(find_pii(df)).collect()}
    assert time.time() - began < 90
    for i, t in enumerate(texts):
        line = ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in (slow(t) if i > 1 else []))
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_candidates_match_all_against_all(spark):
    from genoframe.llm.pii import _candidates

    rng = np.random.default_rng(9)
    rows = []
    for k in range(150):
        spans = set()
        for kind in range(4):  # spans of one kind do not overlap each other
            at = 0
            while len(spans) < 60 and (at := at + int(rng.integers(0, 9))) < 60:
                end = at + int(rng.integers(1, 12))
                spans.add((at, end, "v", kind, bool(rng.random() < 0.4)))
                at = end
        rows.append((k, sorted(spans, key=lambda s: (s[3], s[0]))[: int(rng.integers(0, 40))]))
    kind = "array<struct<start:int,end:int,value:string,kind:int,base:boolean>>"
    got = spark.createDataFrame(rows, f"k int, t {kind}").select("k", _candidates(F.col("t")).alias("c")).collect()
    over = lambda a, b: a[0] < b[1] and b[0] < a[1]
    for r in got:
        spans = rows[r.k][1]
        base = [s for s in spans if s[4]]
        more = [s for s in spans if not s[4] and not any(over(s, b) for b in base)]
        want = base + [s for s in more if not any(over(x, s) and (x[0], x[3]) < (s[0], s[3]) for x in more)]
        assert sorted((c.start, c.end, c.kind) for c in r.c) == sorted((s[0], s[1], s[3]) for s in want)


def test_redaction_of_overlaps(spark):
    spans = [(0, 0, 3, True), (2, 3, 9, False), (8, 1, 12, True), (14, 0, 15, True)]
    df = spark.createDataFrame([("abcdefghijklmnopq", spans)], "t string, s array<struct<start:int,kind:int,end:int,base:boolean>>")
    assert df.select(redact(F.col("t"), F.col("s"))).first()[0] == "[EMAIL]mn[EMAIL]pq"
