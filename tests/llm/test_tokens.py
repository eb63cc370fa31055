"""Operators 1, 3 and 8: against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from textloom.llm import byte_bpe, digest_cache, queries, token_planes

JSON, RANKS, PIECES = (P.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(plane, n):
    x = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4")
    planes = token_planes.to_planes(x, plane)
    assert len(planes) == (4 if plane == "byte" else 32)
    assert (token_planes.from_planes(planes, n, plane) == x).all()


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_file_round_trip(tmp_path, plane):
    uri = f"file://{tmp_path}/x.tlp"
    w = token_planes.PlaneWriter(uri, plane, block=8)
    data = [(1, [1, 2, 3]), (None, []), (5, list(range(70_000, 70_021))), (5, [9])]
    for d, x in data:
        w.add(d, np.array(x, "<u4").tobytes())
    assert w.close()["n_blocks"] == 4
    got = [(d, at, x.tolist()) for d, at, x in token_planes.read_file(uri)]
    assert got == [(1, 0, [1, 2, 3]), (None, 3, []), (5, 3, data[2][1]), (5, 24, [9])]
    (tmp_path / "bad").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        list(token_planes.read_file(f"file://{tmp_path}/bad"))


def test_op1_equals_the_library(spark, docs, rows, library):
    got = token_planes.read_tokens(token_planes.write_tokens(docs, JSON, 2, block=512)).collect()
    want = []
    for i, t, *_ in rows:
        x = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    # Starts are running sums in ascending order of doc_id, nulls first.
    at = 0
    order = [None if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_op1_empty(spark, no_docs):
    assert token_planes.read_tokens(token_planes.write_tokens(no_docs, JSON, 2)).count() == 0


def test_words_are_cut_exactly(library, tik):
    texts = ["don't can't.we'll!!", "a.b,c", "x\ny\n\nz", "two  spaces", " lead", "trail ", "é.ß, ǅ", "1.5 2,000 a1 1a", "_x_ 'quoted' (paren)", "  x", "x　y", "end\n", "a\n b", "!\n?", "²³ Ⅷ x²", ""]
    assert [ids(x) for x in token_planes.library_encoder(JSON)(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids(x) for x in byte_bpe.codec(RANKS, P.PATTERN).encode(pa.array(texts))] == [tik.encode_ordinary(t) for t in texts]


def test_op8_equals_tiktoken(docs, rows, tik):
    got = byte_bpe.encode_decode(docs.select("doc_id", "text", "n", "ids"), RANKS, P.PATTERN).collect()
    by = {r[8]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        text = by[r["n"]][1] or ""
        assert ids(r["ids"]) == tik.encode_ordinary(text) and r["n_tokens"] == len(ids(r["ids"]))
        assert bytes(r["decoded"]).decode() == text


def test_op8_digests(docs, rows, tik):
    want = sorted((r[0] is not None, r[0] or 0, len(x := tik.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    got = byte_bpe.digests(docs, RANKS, P.PATTERN).collect()
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got) == want


def test_op8_empty(no_docs):
    assert byte_bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0


def test_serialised_model_needs_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0, b"b": 2})


@pytest.mark.parametrize("path", [PIECES, JSON])
def test_op3_equals_the_library(docs, rows, library, path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n = (lambda t: len(sp.encode(t))) if path == PIECES else (lambda t: len(library.encode(t, add_special_tokens=False).ids))
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), n(r[1] or "")) for r in rows)
    got = digest_cache.count_tokens(docs, path, 50).collect()
    assert sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in got)


def test_op3_cache_is_used_and_appended(spark, docs, no_docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = {tuple(r) for r in digest_cache.count_tokens(docs, PIECES, 50, cache).collect()}
    entries = spark.read.parquet(cache).count()
    # Entries that were wrong would show: the stored counts answer the second time.
    again = digest_cache.count_tokens(docs, PIECES, 50, cache)
    assert {tuple(r) for r in again.collect()} == first
    assert spark.read.parquet(cache).count() == entries == docs.select("text").na.fill("").distinct().count()
    digest_cache.count_tokens(spark.createDataFrame([(1, "quite new text")], "doc_id long, text string"), PIECES, 50, cache).collect()
    assert spark.read.parquet(cache).count() == entries + 1
    assert digest_cache.count_tokens(no_docs, PIECES, 50, cache).count() == 0


def test_op3_hot_content(spark):
    df = spark.createDataFrame([(i, "hot text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    got = digest_cache.count_tokens(df, PIECES, 2).collect()
    assert len(got) == 900 and len({r["n_tokens"] for r in got if r["doc_id"] % 3}) == 1


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
