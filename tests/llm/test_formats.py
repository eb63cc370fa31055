"""Operators 4 and 5: archives and containers, by round trips and brute force."""

import base64
import hashlib
import os
import random
import struct
import zlib

import pytest

from textloom.llm import iso_media, queries, warc
from textloom.llm.common import open_input

PAGES = "page_id long, url string, html string, digest string, n_rows long, payload string"


def page_rows():
    hot = "<p>the same page</p>"
    rows = [(i, f"http://e.x/{i}", hot if i % 3 == 0 else f"<p>page {i}</p>" * (i % 7 + 1)) for i in range(200)]
    rows += [(300, None, None), (301, "u", ""), (302, "bad\r\nurl", "é😀"), (303, "u", "x" * 300_000), (304, "u", "\x1f\x00 odd"), (305, "u", None)]
    return [(i, u, h, "d", 1, "p") for i, u, h in rows]


def expected(rows):
    best = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        best[b] = max(best.get(b, -1), i)
    out = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        first = best[b] == i
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[b])
    return out


def test_op4(spark, patch_tables):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = queries.op4_warc(spark, patch_tables(pages=pages)).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len(rows)


@pytest.mark.parametrize("split", [100, 1000, 7777, 1 << 22])
def test_any_split_reads_each_record_once(spark, split):
    rows = page_rows()
    index = warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(2))
    got = warc.read_warc(index, split, payloads=True).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    html = {r[0]: r[2] or "" for r in rows}
    assert all(r["html"] == html[r["page_id"]] for r in got if r["record_type"] == "response")
    assert all(r["html"] is None for r in got if r["record_type"] == "revisit")


def test_magic_inside_records_is_passed_over(tmp_path):
    rng = random.Random(2)
    fakes = [b"\x1f\x8b\x08" + rng.randbytes(40), zlib.compress(b"x" * 99), warc.MAGIC * 50]
    data = b"".join(warc.record(i, "u", f"{i} ".encode() + rng.randbytes(300) + rng.choice(fakes) + rng.randbytes(20)) for i in range(60))
    (tmp_path / "x.gz").write_bytes(data)
    for split in (64, 333, 5000):
        seen = []
        with open_input(f"file://{tmp_path}/x.gz") as f:
            for start in range(0, len(data), split):
                seen += [warc.parse(raw)["warc-record-id"] for _, raw in warc.RangeReader(f, start, start + split)]
        assert seen == [f"<urn:page:{i}>" for i in range(60)]


def test_cut_archive_is_an_error(tmp_path):
    data = warc.record(1, "u", b"payload" * 100)
    (tmp_path / "cut.gz").write_bytes(data[:-5])
    with open_input(f"file://{tmp_path}/cut.gz") as f, pytest.raises(ValueError):
        list(warc.RangeReader(f, 0, len(data)))


def test_op4_repeated_and_null_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, "u", "a"), (None, "u", "only"), (0, "u", "a")]
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    kinds = sorted((r["page_id"] is not None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or -1) for r in got)
    assert kinds == sorted([(True, 1, 1, "response", -1), (True, 1, 1, "revisit", 1), (True, 1, 1, "response", -1), (False, 0, 1, "revisit", 1), (False, 0, 4, "response", -1), (True, 0, 1, "revisit", 1)])


def test_op4_empty(spark):
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES))).count() == 0


# -- containers ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 8192, 40_000 * 64 // 64 // 64 * 64])
def test_container_round_trip(n):
    body = random.Random(n).randbytes(n)
    data = iso_media.store(body)
    (track,) = iso_media.describe(data)
    assert iso_media.payload(data, track) == body
    assert track["codec"] == "raw " and track["handler"] == "vide"
    assert sum(s for _, s in track["samples"]) == n and track["duration"] == 40 * len(track["samples"])
    assert [data[a : a + s] for a, s in track["samples"]] == [body[i : i + 4096] for i in range(0, n, 4096)]
    assert track["keys"] == list(range(0, len(track["samples"]), 8))


def test_other_layouts_are_understood():
    """64-bit sizes, version 1 headers, several chunks with runs, co64, no stss, a box to the end of the file."""
    b, f = iso_media.box, iso_media.full
    mdat_first = struct.pack(">I4sQ", 1, b"mdat", 16 + 10) + b"abcdefghij"
    stbl = b(
        b"stbl",
        f(b"stsd", struct.pack(">I", 1), b(b"mp4a", bytes(28))),
        f(b"stts", struct.pack(">III", 1, 5, 10)),
        f(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 3, 1)),
        f(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", 1, 2, 3, 1, 3)),
        f(b"co64", struct.pack(">IQQ", 2, 16, 19)),
    )
    mdhd = b(b"mdhd", struct.pack(">IQQIQ", 1 << 24, 0, 0, 100, 50), bytes(4))
    hdlr = f(b"hdlr", struct.pack(">I4s", 0, b"soun"), bytes(13))
    moov = b(b"moov", b(b"trak", b(b"mdia", mdhd, hdlr, b(b"minf", stbl))))
    data = mdat_first + moov + struct.pack(">I4s", 0, b"free") + b"rest"
    (track,) = iso_media.describe(data)
    assert track["samples"] == [(16, 1), (17, 2), (19, 3), (22, 1), (23, 3)] and track["keys"] is None
    assert (track["timescale"], track["duration"], track["codec"], track["handler"]) == (100, 50, "mp4a", "soun")
    assert iso_media.payload(data, track) == b"abcdefghij"
    assert iso_media.feature(track).startswith("codec=mp4a;seconds=0.500;keyframes=16+1,17+2")


@pytest.mark.parametrize("bad", [b"\0\0\0\x20moov", b"\0\0\0\x04ftyp", b"abc", b"\0\0\0\x01mdat\0\0"])
def test_damaged_containers(bad):
    with pytest.raises(ValueError):
        list(iso_media.walk(bad))


def test_op5(spark, docs, rows, no_docs, patch_tables):
    got = queries.op5_iso_media(spark, patch_tables(documents=docs)).collect()

    def facts(t):
        raw = (t or "").encode()
        p = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(((r[0], *facts(r[1])) for r in rows), key=key)
    same = {}
    for r in got:
        assert same.setdefault(r["payload_sha256"], (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])
    assert iso_media.media_features(iso_media.media_table(no_docs)).count() == 0


def test_archive_index_is_one_file(spark):
    """However many tasks write archives, their index makes one file, and no file that marks it complete."""
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(9)
    index = warc.write_warc(pages)
    assert len(index.inputFiles()) == 1 and index.count() > 1
    folder = index.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert not os.path.exists(f"{folder}/_SUCCESS")
