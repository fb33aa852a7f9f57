"""WARC archives: writing, and reading with segment reassembly and chunked decoding.

`write_archives` makes a response record for each page, or a revisit record where an
equal payload has a response. HTTP bodies are sent in chunks, and a block longer than
`segment_bytes` becomes a first segment and continuation records. Records go through
Spark's text writer, whose line separator is WARC's record end, so any store Spark
writes to can hold the archives; the number of records in a file times the segment size
bounds a file, and so the memory a reader needs. `read_archives` parses each archive,
groups segments by their origin's identifier, orders them by number, verifies that none
is missing and that the total length is right, and then decodes the HTTP framing.

Defined cases: a null html is an empty payload; a null url is left out; pages with a null
page_id never are the first of equal payloads; rows that share the smallest page_id of a
payload are all responses; an empty table gives an archive without records; other
columns are not read. What cannot be parsed is reported in `error`, never dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, scratch, utf8

SEGMENT_BYTES = 64 << 10
RECORDS_PER_FILE = 4096
CHUNK = 8192
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("5f1c3b0e-6f0d-4e5a-9d59-0c2f4d1b7a10")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if len(body) < end + 2 + size + 2 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def decode(block: bytes) -> bytes:
    """The payload of an HTTP response block; a block of another kind is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    return dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def _fields(lines: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.strip().lower(), value.strip()


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def record_id(page_id: str | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{salt}')}>"


def records(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, salt: str = "", segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page without the separator that follows each."""
    digest = payload_digest(payload)
    own = record_id(page_id, salt or digest)
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Tidemark-Page-ID", page_id)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        extra = [("WARC-Refers-To", record_id(refers_to, digest)), ("Tidemark-Refers-To-Page", refers_to), ("Tidemark-Payload-Length", str(len(payload)))]
        yield _record([*head, *common, *extra, kind], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common]
    yield _record([*first, ("WARC-Segment-Number", "1" if len(parts) > 1 else None), kind], parts[0])
    for n, part in enumerate(parts[1:], 2):
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{digest}/{salt}/{n}")), ("WARC-Date", DATE)]
        origin = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        yield _record([*head, *origin, ("WARC-Segment-Total-Length", str(len(block)) if n == len(parts) else None)], part)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of pages(page_id, url, html) under path."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    shared = digests.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sha", "first")
    told = rows.withColumn("sha", F.sha1("html")).join(shared, "sha", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    shaped = told.select(F.col("page_id").cast("string").alias("p"), "url", "html", refers.cast("string").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            out: list[bytes] = []
            size = 0
            for p, u, h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                seen += 1
                salt = "" if r is None and p is not None else f"{payload_digest(h)}/{seen}"
                for x in records(p, u, h, r, salt, segment_bytes):
                    out.append(x)
                    size += len(x)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    text = shaped.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Fields and block of every record of an archive, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(_fields(data[at:end].split(b"\r\n")[1:]))
        size = int(fields[b"content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + size


_PARTS = "k string, number int, total bigint, type string, page_id string, url string, digest string, refers_to string, length bigint, block binary, error string"
_PAGES = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, error string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per page: page_id (text), url, payload_bytes, payload_digest, record_type,
    refers_to (text), payload (null for revisits and without with_payload), error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        kinds = {"number": pa.int32(), "total": pa.int64(), "length": pa.int64(), "block": pa.binary()}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)

        def text(fields: dict[bytes, bytes], name: bytes) -> str | None:
            return fields[name].decode("utf-8", "replace") if name in fields else None

        for b in batches:
            rows: list[tuple] = []
            size = 0
            for where, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for f, block in parse(data):
                        kind, number = text(f, b"warc-type"), int(f.get(b"warc-segment-number", 0))
                        digest = (text(f, b"warc-payload-digest") or "").removeprefix("sha1:")
                        length = int(f.get(b"tidemark-payload-length", 0))
                        kept, error = block if number else None, None
                        if kind == "response" and not number:
                            try:
                                payload = decode(block)
                                length, kept = len(payload), payload if with_payload else None
                                error = None if digest in ("", payload_digest(payload)) else "the digest differs"
                                digest = digest or payload_digest(payload)
                            except ValueError as e:
                                error = str(e)
                        own = text(f, b"warc-record-id")
                        rows.append((text(f, b"warc-segment-origin-id") or own, number, int(f.get(b"warc-segment-total-length", -1)), kind, text(f, b"tidemark-page-id"), text(f, b"warc-target-uri"), digest, text(f, b"tidemark-refers-to-page"), length, kept, error))
                        size += len(kept or b"")
                        if size > 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    rows.append((where, 0, -1, None, None, None, None, None, 0, None, f"{where}: {e}"))
            yield out(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PAGES.split(", ")]
        for b in batches:
            rows = []
            for parts in b.column(0).to_pylist():
                head, error = parts[0], next((p["error"] for p in parts if p["error"]), None)
                if not head["number"] and head["type"] != "continuation":  # whole records; repeated rows share an id
                    rows += [(p["page_id"], p["url"], p["length"], p["digest"], p["type"], p["refers_to"], p["block"], p["error"]) for p in parts]
                    continue
                copies = sum(p["number"] == head["number"] for p in parts)
                length, digest, payload, one = head["length"], head["digest"], None, parts[::copies]
                block = b"".join(p["block"] for p in one)
                if [p["number"] for p in parts] != [n for n in range(1, len(one) + 1) for _ in range(copies)]:
                    error = error or "a segment is missing or repeated"
                elif one[-1]["total"] != len(block):
                    error = error or "the total length differs"
                else:
                    try:
                        payload = decode(block)
                        length, error = len(payload), None if digest in ("", payload_digest(payload)) else "the digest differs"
                    except ValueError as e:
                        error = str(e)
                rows += [(head["page_id"], head["url"], length, digest, head["type"], head["refers_to"], payload if with_payload else None, error)] * copies
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)

    parts = files.mapInArrow(split, _PARTS)
    inside = F.struct("number", "total", "type", "page_id", "url", "digest", "refers_to", "length", "block", "error")
    return parts.groupBy("k").agg(F.array_sort(F.collect_list(inside)).alias("parts")).select("parts").mapInArrow(join, _PAGES)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = load(spark, sf_dir, "pages"), scratch(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    back = read_archives(spark, path, with_payload=False)
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("error")))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
v AS (SELECT page_id, n, h, first, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS g FROM p JOIN f USING (h))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((g[CAST(j // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""
