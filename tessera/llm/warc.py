"""WARC archives: write one record per page, read archives back, reassemble segments.

Writing goes through Spark's text writer (records are UTF-8; its line separator is the
end of a WARC record), so the commit protocol of the shared file system applies and a lost
executor leaves no half archive.  Payloads above ``segment_bytes`` are cut into a first
record and ``continuation`` records; every body has chunked transfer framing.

Reading parses any WARC/1.x file, plain or gzip (one member or one per record).
Continuations are grouped by origin identifier, ordered by segment number and
checked against the total length before the framing is decoded.

Defined results: a null payload is empty; null URLs are written as ``urn:none``; repeated
rows are written, and read, as often as they occur; an incomplete or wrong chain of segments
raises ``ValueError``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_schema, new_folder, small_batches

SEGMENT_BYTES = 8 * 1024
CHUNK_BYTES = 2 * 1024
#: Records per archive file; a record is hardly longer than a segment, so a file that a reader holds is below 64 MB.
RECORDS_PER_FILE = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = (
    "record_id string, origin_id string, segment int, total_length long, record_type string, url string, "
    "page_id long, refers_to string, payload_digest string, payload_bytes long, block binary, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}')}>"


def cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes (at least 4), never inside a UTF-8 character."""
    out, i = [], 0
    while i < len(data):
        j = min(i + size, len(data))
        while j < len(data) and data[j] & 0xC0 == 0x80:
            j -= 1
        if j <= i:  # not UTF-8 here
            j = min(i + size, len(data))
        out.append(data[i:j])
        i = j
    return out or [b""]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size) if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing, with extensions and trailers allowed."""
    out, i = [], 0
    while True:
        j = body.index(b"\r\n", i)
        n = int(body[i:j].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[j + 2 + n : j + 4 + n] != b"\r\n":
            raise ValueError("chunk framing is broken")
        out.append(body[j + 2 : j + 2 + n])
        i = j + 4 + n


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def one_line(s: str) -> str:
    return " ".join(s.split())


def page_records(page_id, url, html, response_id, is_response, segment_bytes: int) -> Iterator[str]:
    """The record of one page, and its continuations, without the closing line ends."""
    payload = (html or "").encode()
    sha = digest(payload)
    own = record_id(page_id, sha)
    common = [f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url or '') or 'urn:none'}"]
    if page_id is not None:
        common.append(f"X-Page-Id: {page_id}")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n".encode()

    def record(lines: list[str], block: bytes) -> str:
        return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]) + block.decode()

    kind = "Content-Type: application/http;msgtype=response"
    if not is_response:
        yield record(
            ["WARC-Type: revisit", f"WARC-Record-ID: {own}", *common, f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Profile: {PROFILE}",
             f"WARC-Refers-To: {record_id(response_id, sha)}", f"X-Refers-To-Page: {response_id}", kind], http)
        return
    block = http + chunked(payload)
    parts = cut(block, segment_bytes)
    first = ["WARC-Type: response", f"WARC-Record-ID: {own}", *common, f"WARC-Payload-Digest: sha1:{sha}", kind]
    if len(parts) == 1:
        yield record(first, block)
        return
    yield record([*first, "WARC-Segment-Number: 1"], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [f"WARC-Segment-Total-Length: {len(block)}"] if k == len(parts) else []
        seg = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{k}')}>"
        yield record(["WARC-Type: continuation", f"WARC-Record-ID: {seg}", *common, f"WARC-Segment-Origin-ID: {own}", f"WARC-Segment-Number: {k}", *last], part)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files below ``path``.

    Among equal payloads of at least ``min_bytes`` bytes that with the largest page_id is the
    response and the others are revisits of it.  Only digest groups with several rows are
    joined back; a very common payload is a skewed join key with one row on the other side.
    """
    small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = p.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = p.join(groups.withColumn("grouped", F.lit(True)), "sha", "left")
    rows = joined.select("page_id", "url", "html", "response_id", (F.col("grouped").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))).alias("is_response"))
    schema = arrow_schema("value string")

    def run(batches):
        for b in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in page_records(*row, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pydict({"value": out}, schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": out}, schema=schema)

    rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by Content-Length."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(n := int(head["content-length"]))
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


def row_of(head: dict[str, str], block: bytes, keep_payload: bool) -> dict:
    kind, origin = head.get("warc-type"), head.get("warc-segment-origin-id")
    segmented = "warc-segment-number" in head
    whole = kind == "response" and not segmented
    payload = http_payload(block) if whole else None
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if whole:
        found = digest(payload)
        if stated and stated.upper() != found:
            raise ValueError(f"digest of {head.get('warc-record-id')} is wrong")
        stated = found
    number = lambda k: int(head[k]) if k in head else None
    return {
        "record_id": head.get("warc-record-id"), "origin_id": origin or (head.get("warc-record-id") if segmented else None), "segment": number("warc-segment-number"),
        "total_length": number("warc-segment-total-length"), "record_type": kind, "url": head.get("warc-target-uri"), "page_id": number("x-page-id"),
        "refers_to": head.get("x-refers-to-page"), "payload_digest": stated, "payload_bytes": len(payload) if whole else None,
        "block": block if segmented else None, "payload": payload if keep_payload else None,
    }


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Every record of the archives below ``path``; blocks only of segmented records."""
    small_batches(spark)
    schema = arrow_schema(READ)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_py())
                zipped = raw.getbuffer()[:2] == b"\x1f\x8b"
                rows, size = [], 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if zipped else raw):
                    rows.append(row_of(head, block, keep_payload))
                    size += len(block)
                    if size > 8_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, READ)


def reassemble(records: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Whole records from segments: group by origin, order, verify, decode.

    Repeated captures of one origin are the same bytes; each segment is kept once with the
    number of its captures, so a group never exceeds one payload.
    """
    first = records.where("origin_id is not null")
    once = first.groupBy("origin_id", "segment").agg(
        F.first("block").alias("block"), F.max("total_length").alias("total_length"), F.count(F.lit(1)).alias("n"),
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("payload_digest").alias("payload_digest"),
    )
    chains = once.groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total_length").alias("total_length"), F.min("n").alias("n"),
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("payload_digest").alias("payload_digest"),
    ).select("origin_id", "page_id", "url", "payload_digest", "total_length", "n", F.col("parts.segment").alias("segments"), F.col("parts.block").alias("blocks"))
    schema = arrow_schema(READ)

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                block = b"".join(x["blocks"])
                if x["segments"] != list(range(1, len(x["segments"]) + 1)) or len(block) != x["total_length"]:
                    raise ValueError(f"segments of {x['origin_id']} are incomplete")
                head = {"warc-type": "response", "warc-record-id": x["origin_id"], "warc-target-uri": x["url"]}
                head |= {"warc-payload-digest": x["payload_digest"]} if x["payload_digest"] else {}
                head |= {"x-page-id": str(x["page_id"])} if x["page_id"] is not None else {}
                row = row_of(head, block, keep_payload)
                yield pa.RecordBatch.from_pylist([row] * x["n"], schema=schema)

    return records.where("origin_id is null").unionByName(chains.mapInArrow(run, READ))


def round_trip(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back; one row per page."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path, min_bytes, segment_bytes)
    whole = reassemble(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    lengths = whole.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    return (
        whole.where("record_type = 'revisit'").join(lengths, "payload_digest", "left")
        .select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
        .unionByName(whole.where("record_type = 'response'"))
    )
