"""WARC archives: a writer with revisit records and a splittable reader (operator 4).

Writer: a record per page, each its own gzip member. Of the records with equal payloads the one with the largest
page_id is a response, the others are revisits of it: headers without the payload. Archives are cut at about
FILE_BYTES.

Reader: a file is cut into byte ranges. A task scans its range for the gzip magic, validates a candidate by inflating
its beginning and decoding all WARC headers, with the required ones among them, and owns each record whose member starts inside its range;
the last one may end beyond it. After an owned member the next one starts where it ends, so that scanning happens once
per range and bytes that only look like a header are passed over.

Defined results: null html is the empty payload; rows with a null page_id are written as records with id "null", read
back with a null id and never chosen as the response of others (a payload that has only such rows: all are responses);
a page_id that repeats gets a record per row
(a repeated row of the largest id with the same payload: one of them is the response, the others revisit it); empty
tables write nothing and give no rows; extra columns are not read. A task that runs again writes a file of its own;
only files named in the index count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, lookup, open_input, open_output, scratch, small_batches, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
PIECE_BYTES = 1 << 14
#: Inflated bytes that must hold the headers of a candidate.
HEADER_BYTES = 1 << 16


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A gzip member with one WARC record: a response with its payload, or a revisit with the response's headers."""
    digest = digest32(payload)
    target = url if url and not any(c in url for c in "\r\n") else "urn:page"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def headers(raw: bytes) -> dict[str, str]:
    """Headers of a record by lower-case name; an error where they aren't whole, well formed and complete."""
    head, end, _ = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not end or not version.startswith("WARC/1.") or not version[7:].isdigit():
        raise ValueError("not a WARC record")
    if not all(x.partition(":")[1] and x.partition(":")[0].strip() for x in lines):
        raise ValueError("a header line without a name")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if any(k not in fields for k in REQUIRED) or not fields["content-length"].isdigit():
        raise ValueError("required headers are missing")
    return fields


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload facts of an inflated record."""
    fields, rest = headers(raw), raw.partition(b"\r\n\r\n")[2]
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    fields["http-length"], fields["payload"] = length, payload
    return fields


class RangeReader:
    """Records whose gzip member starts in [start, end) of a file. Memory: one record and READ_BYTES."""

    def __init__(self, f, start: int, end: int):
        self.f, self.at, self.end = f, start, end
        self.size = f.size()

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(min(n, self.size - at)) if at < self.size else b""

    def _valid(self, at: int) -> bool:
        """Does a member start here whose WARC headers can be decoded?"""
        z, got, pos = zlib.decompressobj(31), b"", at
        try:
            while b"\r\n\r\n" not in got and len(got) < HEADER_BYTES:
                data = z.unconsumed_tail
                if not data:
                    data = self._read(pos, 4096)
                    pos += len(data)
                if not data or z.eof:
                    break
                got += z.decompress(data, HEADER_BYTES - len(got))
            return headers(got) is not None
        except (zlib.error, ValueError):
            return False

    def _first(self) -> int | None:
        """Start of the first member in the range."""
        at, keep = self.at, b""
        while at - len(keep) < self.end:
            data = self._read(at, READ_BYTES)
            if not data:
                return None
            window, base = keep + data, at - len(keep)
            i = window.find(MAGIC)
            while i >= 0 and base + i < self.end:
                if self._valid(base + i):
                    return base + i
                i = window.find(MAGIC, i + 1)
            at += len(data)
            keep = window[-2:]
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self._first()
        buf, base = b"", at
        while at is not None and at < self.end:
            z, parts, pos = zlib.decompressobj(31), [], at
            while not z.eof:
                if not base <= pos < base + len(buf):
                    buf, base = self._read(pos, READ_BYTES), pos
                    if not buf:
                        raise ValueError(f"member at {at} cut short")
                piece = buf[pos - base : pos - base + PIECE_BYTES]
                parts.append(z.decompress(piece))
                pos += len(piece)
            after = pos - len(z.unused_data)
            yield at, b"".join(parts)
            at = after if after < self.size else None


def roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html as bytes ``payload``) with refers_to: null for a response, else the response's id.

    Payloads are compared by SHA-1; only digests, ids and row numbers are grouped. Where a page_id repeats, the rows are
    written with a number each first, and of the rows with a payload's largest id the one with the smallest url, then
    number, is the response.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("row", F.lit(0).cast("long"))
    if pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    # Of structs the largest is that with the largest id; a null id is the smallest.
    place = F.struct("page_id", F.col("url").isNull().alias("none"), "url", "row")
    first = rows.select("digest", place.alias("p")).groupBy("digest", "p.page_id").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("c"))
    best = first.groupBy("digest").agg(F.max("p").alias("best"), F.sum("c").alias("n_rows"))
    out = lookup(rows, best, "digest", "n_rows", pages.count())
    revisit = F.col("best.page_id").isNotNull() & ~((F.col("page_id").eqNullSafe(F.col("best.page_id"))) & F.col("url").eqNullSafe(F.col("best.url")) & (F.col("row") == F.col("best.row")))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("best.page_id")).alias("refers_to"))


INDEX = "path string, size long, n_records long"


def write_warc(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder; returns their index, a written table (path, size, n_records)."""
    spark = attach(pages.sparkSession)
    folder = scratch(spark, "warc")
    rows = roles(pages)
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n, done = None, "", 0, 0, []
        for batch in small_batches(batches, "payload"):
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size, n = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_output(path)
                data = record(page, url, payload, refers)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((path, size, n))
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "size", "n_records"])

    # A row or a few per task: one file, not one per task.
    return written(rows.mapInArrow(write, INDEX).repartition(1), "warc-index")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_warc(files: DataFrame, split: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """Records of the archives in ``files`` (path, size), read by byte ranges of ``split`` bytes; with ``payloads``
    the html of responses as well. A payload that doesn't have the digest its header names is an error."""
    spark = attach(files.sparkSession)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges.repartition(n, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_input(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for _, raw in RangeReader(f, start, start + split):
                        rows.append(_row(parse(raw), payloads))
                        held += len(raw)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    out = ranges.mapInArrow(read, RECORDS)
    return out if payloads else out.drop("html")


def _row(r: dict, payloads: bool) -> tuple:
    revisit = r["warc-type"] == "revisit"
    digest = r["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (digest32(r["payload"]) != digest or len(r["payload"]) != r["http-length"]):
        raise ValueError(f"payload of {r['warc-record-id']} is damaged")
    number = lambda x: None if x is None or "null" in x else int(x.strip("<>").rpartition(":")[2])
    html = r["payload"].decode("utf-8") if payloads and not revisit else None
    return number(r["warc-record-id"]), r["warc-target-uri"], r["http-length"], digest, r["warc-type"], number(r.get("warc-refers-to")), html


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])
