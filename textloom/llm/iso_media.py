"""Media columns: ISO base-media containers (operator 5).

``store`` puts a payload losslessly into an ISO container (ftyp, moov with one video track of raw 8-bit samples, mdat);
``walk`` follows nested boxes; ``describe`` decodes the sample tables (stsd, mdhd, stts, stsc, stsz, stco/co64, stss)
and gives codec, duration and the byte ranges of samples and keyframes without touching the payload; ``payload``
reads the samples at those ranges.

Defined results: a null text is the empty text; its payload is 64 zero bytes. Payloads end on the next positive
multiple of 64. Equal texts give equal containers. Empty tables give no rows. A damaged container raises ValueError.
Long payloads have 64-bit boxes and offsets beyond 4 GB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, small_batches, texts_of, written

UNIT = 64
FRAME = 4096
KEYFRAME_EVERY = 8
TIMESCALE = 1000
FRAME_TICKS = 40
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """An ISO container with ``payload`` (a multiple of 64 bytes, 64 at least) as raw samples of FRAME bytes."""
    n = -(-len(payload) // FRAME)
    last = len(payload) - (n - 1) * FRAME
    duration = n * FRAME_TICKS
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 64, 64, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    times = [(n, FRAME_TICKS)]
    sizes = struct.pack(">II", FRAME, n) if last == FRAME else struct.pack(">II", 0, n) + struct.pack(f">{n}I", *[FRAME] * (n - 1), last)
    keys = list(range(1, n + 1, KEYFRAME_EVERY))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        place = full(b"co64", struct.pack(">IQ", 1, first)) if first >= 1 << 32 else full(b"stco", struct.pack(">II", 1, first))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times)),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            full(b"stsz", sizes),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            place,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        hdlr = full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"\0")
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)), hdlr, minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(16), MATRIX, struct.pack(">II", 64 << 16, 64 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(size) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, body start, body end) of each box, nested ones included; sizes 0 and 1 as the format has them."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("box header cut short")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} runs over its parent")
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, here)
        start = stop


def _ints(data: bytes, at: int, n: int, code: str = "I") -> tuple[int, ...]:
    return struct.unpack_from(f">{n}{code}", data, at)


def describe(data: bytes) -> list[dict]:
    """Per track: codec, handler, timescale, duration, samples [(offset, size)] and keyframes (their indexes, or None for all)."""
    tracks: list[dict] = []
    for path, at, _ in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": None, "handler": None, "timescale": 0, "duration": 0, "keys": None})
        if b"trak" not in path or kind in CONTAINERS:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            v1 = data[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if v1 else ">II", data, at + (20 if v1 else 12))
        elif kind == b"hdlr":
            t["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stts":
            t["times"] = list(zip(*[iter(_ints(data, at + 8, 2 * _ints(data, at + 4, 1)[0]))] * 2, strict=True))
        elif kind == b"stsc":
            t["runs"] = list(zip(*[iter(_ints(data, at + 8, 3 * _ints(data, at + 4, 1)[0]))] * 3, strict=True))
        elif kind == b"stsz":
            one, n = _ints(data, at + 4, 2)
            t["sizes"] = [one] * n if one else list(_ints(data, at + 12, n))
        elif kind == b"stco":
            t["places"] = _ints(data, at + 8, _ints(data, at + 4, 1)[0])
        elif kind == b"co64":
            t["places"] = _ints(data, at + 8, _ints(data, at + 4, 1)[0], "Q")
        elif kind == b"stss":
            t["keys"] = [k - 1 for k in _ints(data, at + 8, _ints(data, at + 4, 1)[0])]
    for t in tracks:
        t["samples"] = _samples(t)
    return tracks


def _samples(t: dict) -> list[tuple[int, int]]:
    """Byte range of each sample, by the runs of samples per chunk."""
    out: list[tuple[int, int]] = []
    runs, sizes = t.get("runs", []), t.get("sizes", [])
    for i, (first, per_chunk, _) in enumerate(runs):
        until = runs[i + 1][0] if i + 1 < len(runs) else len(t["places"]) + 1
        for chunk in range(first, until):
            at = t["places"][chunk - 1]
            for size in sizes[len(out) : len(out) + per_chunk]:
                out.append((at, size))
                at += size
    return out


def payload(data: bytes, track: dict) -> bytes:
    """The samples' bytes, joined where they lie side by side."""
    spans: list[list[int]] = []
    for at, size in track["samples"]:
        if spans and spans[-1][1] == at:
            spans[-1][1] += size
        else:
            spans.append([at, at + size])
    return b"".join(data[a:b] for a, b in spans)


def feature(track: dict) -> str:
    """codec, duration in seconds and keyframe byte ranges as text."""
    keys = range(len(track["samples"])) if track["keys"] is None else track["keys"]
    ranges = ",".join(f"{track['samples'][k][0]}+{track['samples'][k][1]}" for k in keys)
    return f"codec={track['codec'].strip()};seconds={track['duration'] / max(1, track['timescale']):.3f};keyframes={ranges}"


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + bytes(max(1, -(-len(raw) // unit)) * unit - len(raw))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of each text, written to the shared folder and read back."""
    attach(docs.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            raw = [t.encode() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(put, "doc_id long, n_bytes long, media binary"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Per row of a media table: digests of what the container holds, and its feature text."""
    attach(media.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media", 4 << 20):
            out: list[tuple] = []
            for doc, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                track = describe(data)[0]
                body = payload(data, track)
                out.append((doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(look, FEATURES)
