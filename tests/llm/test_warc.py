import gzip
import hashlib

import numpy as np
from genoframe.llm.common import scratch
from genoframe.llm.warc import (
    archive_index, base32_sha1, chunked, http_payload, parse_records, read_archives, record, response_records, unchunked, write_archives,
)


def test_framing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 100):
        body = bytes(rng.integers(0, 256, n, np.uint8))
        assert unchunked(chunked(body, 8)) == body
    assert unchunked(b"4;x=y\r\nabcd\r\n0\r\n\r\n") == b"abcd"
    for broken in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX\r\n0\r\n"):
        assert unchunked(broken) is None
    assert http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain" and http_payload(b"junk") is None


def test_records_parse_plain_and_gzipped():
    data = b"\r\n\r\n".join(response_records("urn:a", "http://x/ y", b"q" * 500 + b"\r\n\r\nWARC/1.1\r\n", 120)) + b"\r\n\r\n"
    for form in (data, gzip.compress(data)):
        rows = list(parse_records(form))
        assert rows[0][0]["warc-type"] == "response" and rows[-1][0]["warc-type"] == "continuation"
        assert http_payload(b"".join(b for _, b in rows)) == b"q" * 500 + b"\r\n\r\nWARC/1.1\r\n"


def pages():
    rng = np.random.default_rng(1)
    big = "".join(rng.choice(list("é<p>\r\n"), 5000))
    rows = [(k, f"http://h/{k}", big if k % 3 == 0 else f"page {k}") for k in range(40)]
    return rows + [(100, None, None), (101, "http://x/\r\nEvil: 1", ""), (7, "http://h/7", "page 7"), (None, "u", "nobody"), (200, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n")]


def test_archives_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as serial", "2 as sha")
    path = scratch(spark, "warc-test")
    write_archives(df, path, segment_bytes=700, records_per_file=9)
    archive = read_archives(spark, path)
    assert all(r.valid for r in archive.collect())
    payloads = sorted(bytes(r.payload).decode() for r in archive.collect() if r.record_type == "response")
    assert payloads == sorted({h or "" for _, _, h in rows})
    got = sorted(map(tuple, archive_index(archive).collect()), key=str)
    want, seven = [], 0
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = max(same, default=None)
        seven += i == 7
        revisit = first != i or (i == 7 and seven == 2)
        want.append((i, len(body), base32_sha1(body), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_damage_is_found(spark, tmp_path):
    parts = response_records("urn:a", "u", b"x" * 900, 300)
    cases = {"whole": parts, "missing": parts[:1] + parts[2:], "no-end": parts[:-1], "double": parts + parts[1:2]}
    swapped = [parts[0].replace(b"xxxx", b"yyyy", 1), *parts[1:]]
    cases["digest"] = swapped
    for name, records in cases.items():
        d = tmp_path / name
        d.mkdir()
        (d / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [record("warcinfo", "urn:i", [], b"software: x"), *records[::-1]]))
        r = read_archives(spark, str(d)).collect()
        assert len(r) == 1 and r[0].valid == (name == "whole")
        assert (r[0].payload is None) == (name != "whole")


def test_empty(spark):
    path = scratch(spark, "warc-test")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archive_index(read_archives(spark, path)).count() == 0


def test_digest():
    assert base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_damaged_files_are_read_on(spark, tmp_path):
    from genoframe.llm.warc import damage

    good = [record("response", f"urn:{k}", [], b"HTTP/1.1 200 OK\r\n\r\nbody %d" % k) for k in range(4)]
    bad = good[1].replace(b"Content-Length: ", b"Content-Length: x")
    beyond = good[2].replace(b"Content-Length: 25", b"Content-Length: 9999")
    assert bad != good[1] and beyond != good[2]
    end = b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good[0] + end + b"stray\r\nbytes" + end + bad + end + beyond + end + good[3] + end)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", "urn:9", [], b"HTTP/1.1 200 OK\r\n\r\nnine") + end) + gzip.compress(good[0])[:-12])
    rows = read_archives(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"body 0", b"body 3", b"nine"]
    lost = damage(spark, str(tmp_path)).first()
    assert lost.pieces == 5 and lost.bytes > 300  # the cut member: its whole rest, and the record that it breaks off in
