"""WARC archives: writing pages as records, and reassembling segmented records.

Writing gives gzipped WARC/1.1 files. A block longer than ``segment_bytes`` is cut
into a first record and continuation records, which bounds a record and, with the
number of records to a file, a file. Of records with equal payloads one is a
response and the others revisit it.

Reading parses files record by record; what is damaged is passed over up to the next
record and counted (:func:`damage`). It groups continuation records by the
identifier of their origin, orders them by segment number, verifies that numbers
have no gap and that the total length agrees, and decodes chunked transfer framing.
Only segmented records are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm.common import cut, lookup_skewed

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 1_000
_GAP = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The body of a chunked message; None if its framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or framed[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(framed[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, transfer framing removed; None if broken."""
    head, gap, body = block.partition(_GAP)
    if not gap:
        return None
    framing = re.search(rb"(?im)^transfer-encoding:[ \t]*([^\r\n]*)", head)
    if framing and b"chunked" in framing[1].lower():
        return unchunked(body)
    return body


def record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"{k}: {re.sub(r'[\x00-\x20\x7f]', lambda m: quote(m[0]), v)}" for k, v in fields if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + _GAP + block


def response_records(record_id: str, uri: str | None, payload: bytes, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        return [record("response", record_id, common, block)]
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [record("response", record_id, [*common, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record("continuation", f"{record_id}:segment:{k}", fields, part))
    return out


def unzipped(data: bytes) -> tuple[bytes, bytes]:
    """The content of a file of gzip members, and what cannot be unzipped from where it breaks."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            return b"".join(out), data
        if not member.eof:
            return b"".join(out), data
        data = member.unused_data
    return b"".join(out), b""


_BEGIN = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a file, gzipped or plain.

    What is no whole record (stray bytes, a header without end, a length that is no number
    or beyond the end of the file) comes as one block of type ``damaged`` that goes on to
    the next place where a record begins.
    """
    broken = b""
    if data[:2] == b"\x1f\x8b":
        data, broken = unzipped(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            break
        begin, end = _BEGIN.match(data, at), data.find(_GAP, at)
        if begin and end >= 0:
            fields = {}
            for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
            size = fields.get("content-length", "")
            if size.isascii() and size.isdigit() and end + 4 + int(size) <= len(data):
                yield fields, data[end + 4 : end + 4 + int(size)]
                at = end + 4 + int(size)
                continue
        after = _BEGIN.search(data, begin.end() if begin else at)
        stop = after.start() if after else len(data)
        yield {"warc-type": "damaged"}, data[at:stop]
        at = stop
    if broken:
        yield {"warc-type": "damaged"}, broken


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one record (with its continuations) for each row under ``path``.

    Of rows with equal payloads that of the largest id (of repeated ids that of the
    largest hash of the URL, of rows equal in all one) is the response; null ids are
    smallest and null html is the empty payload. A response is named
    ``urn:page:<id>:<SHA-1>``, so every row of its group knows the name from content
    alone, whatever is computed again; a revisit has a serial number. Other columns are
    not looked at.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    rows = rows.withColumns({"group": F.concat_ws(":", "sha", F.length("payload").cast("string")), "u": F.xxhash64("url")})
    # Only groups of several rows need a look-up. ``times``: how often their first row comes.
    same = rows.groupBy("group", "page_id", "u").agg(F.count("*").alias("times"))
    groups = same.groupBy("group").agg(F.max(F.struct("page_id", "u", "times")).alias("first"), F.sum("times").alias("n")).filter("n > 1")
    groups = cut(groups.select("group", "first", "n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    # Groups of more than a thousandth of these rows are a thousand at most: they are broadcast.
    hot = groups.filter(F.col("n") > max(1000, total // 1000)).drop("n")
    names = [r[0] for r in hot.select("group").collect()]
    cold = rows.filter(~F.col("group").isin(names)) if names else rows
    marked = cold.join(groups.drop("n"), "group", "left")
    if names:
        marked = marked.unionByName(rows.filter(F.col("group").isin(names)).join(F.broadcast(hot), "group"))
    own = F.struct(F.col("page_id").alias("page_id"), F.col("u").alias("u"))
    is_first = F.col("first").isNotNull() & own.eqNullSafe(F.struct(F.col("first.page_id").alias("page_id"), F.col("first.u").alias("u")))
    marked = marked.withColumns({"is_first": is_first, "serial": F.monotonically_increasing_id()})
    shown = ["page_id", "url", "payload", "sha", "first", "is_first", "serial"]
    if groups.filter("first.times > 1").isEmpty():
        marked = marked.select(*shown, F.lit(0).alias("copy"))
    else:  # a first row that comes several times: its copies are drawn from one of them
        repeated = F.col("is_first") & (F.col("first.times") > 1)
        copied = marked.filter(repeated).groupBy("group").agg(*[F.any_value(c).alias(c) for c in ("page_id", "url", "payload", "sha", "first", "serial")])
        copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("first.times").cast("int")))).withColumn("is_first", F.col("copy") == 1)
        marked = marked.filter(~repeated).select(*shown, F.lit(0).alias("copy")).unionByName(copied.select(*shown, "copy"))

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda i, end: f"urn:page:{'' if i is None else quote(str(i), safe='')}:{end}"
        for b in batches:
            out = []
            for page_id, url, payload, sha, first, is_first, serial, copy in zip(*(b.column(c).to_pylist() for c in [*shown, "copy"])):
                if first is None or is_first:
                    out += response_records(name(page_id, sha), url, payload, segment_bytes)
                else:
                    fields = [
                        ("WARC-Target-URI", url),
                        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
                        ("WARC-Profile", _PROFILE),
                        ("WARC-Refers-To", f"<{name(first['page_id'], sha)}>"),
                    ]
                    out.append(record("revisit", name(page_id, f"{serial}.{copy}"), fields, b""))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = marked.mapInArrow(serialise, "record binary")
    # A text sink writes bytes as they are; the record separator is the line separator.
    writer = records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n")
    writer.option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


_RECORD = "record_id string, record_type string, uri string, digest string, refers_to string, origin string, number int, total long, block binary"


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of all files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda v: v.strip("<>") if v else None
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f, block in parse_records(content.as_py()):
                    number, total = (int(x) if x.isascii() and x.isdigit() and len(x) < 10 else None for x in (f.get("warc-segment-number", ""), f.get("warc-segment-total-length", "")))
                    rows.append(
                        (
                            bare(f.get("warc-record-id")),
                            f.get("warc-type"),
                            f.get("warc-target-uri"),
                            (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                            bare(f.get("warc-refers-to")),
                            bare(f.get("warc-segment-origin-id")),
                            number,
                            total,
                            block,
                        )
                    )
                kinds = [*[pa.string()] * 6, pa.int32(), pa.int64(), pa.binary()]
                columns = list(zip(*rows)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = [x.split()[0] for x in _RECORD.split(", ")]
    return files.mapInArrow(parse, _RECORD)


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(pieces, bytes): how often reading had to pass over something, and how much."""
    broken = scan_records(spark, path).filter("record_type = 'damaged'")
    return broken.agg(F.count("*").alias("pieces"), F.coalesce(F.sum(F.length("block")), F.lit(0)).alias("bytes"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, uri, refers_to, payload, digest, valid) of responses and revisits.

    ``payload`` is reassembled and unframed, null for revisits; ``digest`` is the payload's
    own, for revisits the recorded one. ``valid`` is false where a segment is missing or
    doubled, the total length differs, the framing is broken or the digest disagrees; the
    payload is then null. Other record types are left out.
    """
    records = scan_records(spark, path)
    facts = ["record_id", "record_type", "uri", "digest", "refers_to"]
    whole = records.filter(F.col("number").isNull() & F.col("record_type").isin("response", "revisit")).select(*facts, "block", F.lit(True).alias("complete"))
    parts = records.filter(F.col("number").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))
    grouped = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max_by(F.struct(*facts), -F.col("number")).alias("head"),
    )
    numbers, blocks = F.transform("parts", lambda p: p["number"]), F.transform("parts", lambda p: p["block"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    complete = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (length == F.col("total"))
    joined = F.aggregate(blocks, F.lit(b""), lambda a, b: F.concat(a, b))
    rebuilt = grouped.select("head.*", joined.alias("block"), F.coalesce(complete, F.lit(False)).alias("complete"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, digests, valid = [], [], []
            for kind, digest, block, complete in zip(*(b.column(c) for c in ("record_type", "digest", "block", "complete"))):
                kind, digest = kind.as_py(), digest.as_py()
                payload = http_payload(block.as_py()) if kind == "response" and complete.as_py() else None
                own = base32_sha1(payload) if payload is not None else digest
                good = kind == "revisit" or (payload is not None and digest in (None, own))
                payloads.append(payload if good else None)
                digests.append(own)
                valid.append(good)
            kept = [b.column(c) for c in ("record_id", "record_type", "uri", "refers_to")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(valid, pa.bool_())],
                names=["record_id", "record_type", "uri", "refers_to", "payload", "digest", "valid"],
            )

    return whole.unionByName(rebuilt).mapInArrow(
        decode, "record_id string, record_type string, uri string, refers_to string, payload binary, digest string, valid boolean"
    )


def page_of(record_id, kind: str):
    """The page id inside a record identifier that :func:`write_archives` made."""
    spelt = F.url_decode(F.split(record_id, ":")[2])
    return F.when(spelt != "", spelt).cast(kind)


def archive_index(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; a revisit has its response's size."""
    # Written, as it is used several times: the archive is then parsed once.
    rows = cut(archive.select("record_id", "record_type", "refers_to", "digest", F.length("payload").cast("long").alias("size")))
    revisits = rows.filter("record_type = 'revisit'").withColumn("target", F.coalesce("refers_to", F.lit("")))
    wanted = revisits.groupBy("target").agg(F.count("*").alias("n"))
    sizes = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("size").alias("full"))
    # A target that the archive lacks gives a revisit without size.
    resolved = lookup_skewed(revisits, cut(wanted.join(sizes, "target", "left")), "target", "n")
    shown = lambda size: [
        page_of(F.col("record_id"), id_type).alias("page_id"),
        size.alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to"), id_type).alias("refers_to"),
    ]
    return rows.filter("record_type = 'response'").select(*shown(F.col("size"))).unionByName(resolved.select(*shown(F.col("full"))))
