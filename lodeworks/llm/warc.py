"""WARC archives: a writer that segments large records and a reader that puts the segments together again.

The writer makes one record per row (``response``, or ``revisit`` where an earlier record holds an equal payload), cuts
a block longer than ``segment_bytes`` into a first record and ``continuation`` records, and writes gzipped archives with
Spark's own sink into the shared folder. The reader parses the archives by Content-Length, groups continuation records by
their origin identifier, orders them by segment number, verifies the total length, and decodes chunked transfer framing.
Only segmented records are shuffled; files are bounded by records a file times bytes a segment.

Defined results: a null payload is an empty one; a null page_id has an empty id part and comes back as null; identical
rows (same page_id and payload) are all ``response`` if theirs is the smallest page_id; a record whose segments are
missing, repeated unevenly or of the wrong total length comes back with ``complete`` false and a null payload; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

VERSION = b"WARC/1.1"
END_OF_RECORD = "\r\n\r\n"
#: Longest block of a record; longer ones are segmented.
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 2000
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> bytes:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>".encode()


def page_of(identifier: str | None) -> int | None:
    part = identifier.split(":")[2] if identifier else ""
    return int(part) if part else None


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            raise ValueError("the last chunk is cut off")
        at = end + 2 + n + 2


def fields_of(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    if fields_of(head).get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunked(body)
    return body


def one_record(kind: bytes, identifier: bytes, block: bytes, more: list[tuple[bytes, bytes]]) -> bytes:
    """A record without the two line ends that close it."""
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", identifier), (b"WARC-Date", b"2000-01-01T00:00:00Z"), *more, (b"Content-Length", b"%d" % len(block))]
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + block


def records_of(page_id: int | None, payload: bytes, refers_to: int | None, revisit: bool, size: int | None, digest: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response with its continuations."""
    if revisit:
        told = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        more = [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", record_id(refers_to, digest)), (b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Type", b"application/http;msgtype=response")]
        yield one_record(b"revisit", record_id(page_id, digest), told, more)
        return
    digest = digest_of(payload)
    identifier = record_id(page_id, digest)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    more = [(b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Type", b"application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield one_record(b"response", identifier, block, more)
        return
    yield one_record(b"response", identifier, block[:segment_bytes], [*more, (b"WARC-Segment-Number", b"1")])
    for k, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        more = [(b"WARC-Segment-Origin-ID", identifier), (b"WARC-Segment-Number", b"%d" % k)]
        if at + segment_bytes >= len(block):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield one_record(b"continuation", identifier[:-1] + b":%d>" % k, block[at : at + segment_bytes], more)


def digests(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, hex SHA-1 and bytes of each payload, in the JVM."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col(page_id).alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))


def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to, sha1, bytes) of every page whose payload of ``min_bytes`` or more a smaller page_id holds too."""
    told = digests(pages, page_id, html).where(F.col("bytes") >= min_bytes)
    first = told.groupBy("sha1", "bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return told.join(first, ["sha1", "bytes"]).where("page_id <> refers_to").select("page_id", "refers_to", "sha1", "bytes").distinct()


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", html: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a WARC record per row of ``pages`` below ``path``."""
    again = revisits(pages, page_id, html, min_bytes).select(F.col("page_id").alias("again_id"), "refers_to", F.col("sha1").alias("again_sha1"), F.col("bytes").alias("again_bytes"))
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")
    revisit = F.col("again_id").isNotNull()
    rows = rows.select("page_id", F.when(~revisit, F.col("payload")).alias("payload"), "refers_to", revisit.alias("revisit"), "again_bytes", "again_sha1")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            held = 0
            for page, payload, refers, is_revisit, size, sha1 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode() if is_revisit else None
                for r in records_of(page, payload or b"", refers, is_revisit, size, digest, segment_bytes):
                    out.append(r)
                    held += len(r)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    written = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    # the sink puts the line separator after each row: the two line ends that close a record
    written.write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each record, framed by Content-Length."""
    if archive[:2] == b"\x1f\x8b":
        parts = []
        while archive:  # one member or one a record
            d = zlib.decompressobj(31)
            parts.append(d.decompress(archive) + d.flush())
            archive = d.unused_data
        archive = b"".join(parts)
    at = 0
    while True:
        while archive[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(archive):
            return
        if archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record starts at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        head = fields_of(archive[at:end])
        n = int(head[b"content-length"])
        block = archive[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("the last record is cut off")
        yield head, block
        at = end + 4 + n


READ = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, complete boolean"


def told(head: dict[bytes, bytes], block: bytes, with_payload: bool) -> tuple:
    """A whole record's row; a payload that can't be decoded or doesn't match its digest makes it incomplete."""
    kind = head[b"warc-type"].decode()
    stated = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
    if kind == "revisit":
        size = fields_of(block.partition(b"\r\n\r\n")[0]).get(b"content-length")
        payload, n, digest, ok = None, int(size) if size else None, stated, True
    else:
        try:
            payload = payload_of(block)
        except ValueError:
            payload = None
        n, digest = (None, None) if payload is None else (len(payload), digest_of(payload))
        ok = payload is not None and stated in (None, digest)
    refers = head.get(b"warc-refers-to")
    row = (head[b"warc-record-id"].decode(), kind, refers.decode() if refers else None, n, digest, ok)
    return (*row, payload) if with_payload else row


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per logical record: its segments are put together and its transfer framing is removed."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = READ + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [told(head, block, with_payload) for head, block in parse(content.as_py()) if b"warc-segment-number" not in head]
                yield batch(rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [
                    (head.get(b"warc-segment-origin-id", head[b"warc-record-id"]).decode(), int(head[b"warc-segment-number"]), int(head.get(b"warc-segment-total-length", b"-1")), head.get(b"warc-payload-digest"), block)
                    for head, block in parse(content.as_py())
                    if b"warc-segment-number" in head
                ]
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, ["origin", "number", "total", "stated", "block"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, segments in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_number: dict[int, list[bytes]] = defaultdict(list)
                for s in segments:
                    by_number[s["number"]].append(s["block"])
                total = max(s["total"] for s in segments)
                stated = next((s["stated"] for s in segments if s["stated"]), b"")
                copies = len(by_number.get(1, ()))
                even = sorted(by_number) == list(range(1, len(by_number) + 1)) and all(len(v) == copies and len(set(v)) == 1 for v in by_number.values())
                block = b"".join(by_number[k][0] for k in sorted(by_number))
                head = {b"warc-type": b"response", b"warc-record-id": origin.encode(), b"warc-payload-digest": stated}
                if even and len(block) == total:
                    yield batch([told(head, block, with_payload)] * copies)
                else:
                    row = (origin, "response", None, None, None, False)
                    yield batch([(*row, None) if with_payload else row])

    parts = files.mapInArrow(pieces, "origin string, number long, total long, stated binary, block binary")
    grouped = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "stated", "block"))).alias("segments"))
    return files.mapInArrow(whole, schema).unionByName(grouped.mapInArrow(assemble, schema))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path, with_payload=False)
    page = lambda c: F.expr(f"try_cast(nullif(split({c}, ':')[2], '') as bigint)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS lead, sha1(payload) AS h FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM f
"""
