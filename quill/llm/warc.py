"""WARC records as a chunked table: a payload is rows of (record, chunk number, bytes).

Chunk 0 holds the record's headers and the first payload bytes, later chunks the rest, each at
most ``CHUNK`` payload bytes, and every row carries the digest of the payload so far. Reading
feeds one chunk at a time to a parser that keeps headers, counters and a digest, never a payload.
The bytes of a record's chunks in order are a valid WARC/1.1 record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.shared import lean, written

CHUNK = 1 << 16
#: Equal payloads of at least so many bytes become revisits.
REVISIT_BYTES = 1000
#: The table has no capture times.
DATE = "1970-01-01T00:00:00Z"
CHUNK_SCHEMA = "record bigint, chunk_no int, last boolean, data binary, digest string"
RECORD_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean"


def _digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def headers(page_id, url, kind: str, refers_to, size: int, digest: str) -> bytes:
    """WARC and HTTP headers of one record; a revisit has no payload, and so gives its size in a header of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", _digest(digest)), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(size))]
    fields.append(("Content-Length", str(len(http) + (size if kind == "response" else 0))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def chunks(head: bytes, payload: memoryview, size: int = CHUNK) -> Iterator[tuple[int, bool, bytes, str]]:
    """Chunk number, whether it is the last, its bytes, and the payload's digest so far."""
    seen, n = hashlib.sha1(), max(1, -(-len(payload) // size))
    for k in range(n):
        part = payload[k * size : (k + 1) * size]
        seen.update(part)
        yield k, k == n - 1, (head if not k else b"") + part.tobytes() + (b"\r\n\r\n" if k == n - 1 else b""), seen.copy().hexdigest()


class Parser:
    """One record, fed chunk by chunk."""

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.buffer, self.left, self.size, self.sha, self.running = b"", 0, 0, hashlib.sha1(), True

    def feed(self, data: bytes, digest: str) -> None:
        if self.fields is None:
            head, _, rest = data.partition(b"\r\n\r\n")
            self.fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            http, _, data = rest.partition(b"\r\n\r\n")
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
        part = data[: self.left]
        self.left -= len(part)
        self.size += len(part)
        self.sha.update(part)
        self.running &= self.sha.copy().hexdigest() == digest or self.fields["WARC-Type"] == "revisit"

    def row(self) -> tuple:
        f = self.fields or {}
        number = lambda s: None if not s or s == "<urn:page:None>" else int(s[len("<urn:page:") : -1])
        stated = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
        revisit = f["WARC-Type"] == "revisit"
        size, digest = (int(f["X-Payload-Length"]), stated) if revisit else (self.size, self.sha.hexdigest())
        return number(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], number(f.get("WARC-Refers-To")), size, digest, self.left == 0 and self.running and digest == stated


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, refers_to of the pages whose payload a page with a larger id has too."""
    keyed = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    kept = keyed.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    return keyed.join(kept, ["digest", "size"]).where("page_id < refers_to").select("page_id", "refers_to").distinct()


def archived(pages: DataFrame) -> DataFrame:
    """The chunk table of ``pages`` (page_id, url, html), written to the shared folder.

    The table of revisits is written first: Spark knows its size and broadcasts it only if that
    is below its threshold; else it joins by sort and merge.
    """
    links, _ = written(revisits(pages), "revisits")
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), F.sha1(F.coalesce("html", F.lit(""))).alias("digest")).join(links, "page_id", "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = TaskContext.get().partitionId() << 33
        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
        for b in it:
            out, held = [], 0
            for page_id, url, payload, digest, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                body = memoryview(payload.as_buffer())
                kind = "response" if refers_to is None else "revisit"
                head = headers(page_id, url, kind, refers_to, len(body), digest)
                for row in chunks(head, body if kind == "response" else body[:0]):
                    out.append((record, *row))
                    held += len(row[2])
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
                record += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return written(rows.mapInArrow(lean(batches), CHUNK_SCHEMA), "warc")[0]


def records(table: DataFrame) -> DataFrame:
    """One row per record of a chunk table.

    Records of one chunk are parsed where they lie. The chunks of larger ones are dealt by record
    and sorted, so that a task sees them in order and keeps one parser at a time.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        parser = Parser()
        for b in it:
            out = []
            for last, data, digest in zip(b.column("last").to_pylist(), b.column("data"), b.column("digest").to_pylist(), strict=True):
                parser.feed(data.as_py(), digest)
                if last:
                    out.append(parser.row())
                    parser = Parser()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    whole = (F.col("chunk_no") == 0) & F.col("last")
    large = table.where(~whole).repartition("record").sortWithinPartitions("record", "chunk_no")
    return table.where(whole).mapInArrow(lean(batches), RECORD_SCHEMA).unionByName(large.mapInArrow(lean(batches), RECORD_SCHEMA))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC records, read the archives back.

    Null html: an empty payload. Null url: an empty URI. A null page_id is never a revisit or
    referred to. Rows that repeat a page_id are records of their own; they are revisits of a
    larger page_id alike. Other columns are not read. An empty table gives an empty one.
    """
    return records(archived(pages))
