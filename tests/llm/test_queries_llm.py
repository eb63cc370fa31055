"""Registered queries: against their SQL, and whole queries against the libraries where SQL can't express them."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from test_dedup import items_and_docs, line_rows, near_rows, passage_rows

from textloom.llm import decontaminate, digest_cache, language, queries, toxicity, warc

DOCS = "doc_id long, text string"


def same_rows(name, spark, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in found.description]
    out = queries.QUERIES[name](spark, folder)
    assert sorted(out.columns) == sorted(cols)
    got = sorted((tuple(r[c] for c in cols) for r in out.collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)
    return got


@pytest.fixture(scope="module")
def tables(spark, patch_tables):
    items, docs = items_and_docs(4)
    texts = [t for _, t in docs] + [t for _, t in line_rows(3)] + [t for _, t in near_rows(4)] + [t for _, t in passage_rows()]
    docs = list(enumerate(t for t in texts if len(t or "") < 5000))
    items = [(i, t) for i, t in items if i is not None]
    pages = [(i, f"http://h/{i % 3}", t) for i, t in docs] + [(1000 + i, None, t) for i, t in docs[:40]]
    return patch_tables(documents=spark.createDataFrame(docs, DOCS), benchmark=spark.createDataFrame(items, "item_id long, text string"), pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    assert len(same_rows(name, spark, tables)) > 300


@pytest.fixture(scope="module")
def awkward(spark, docs, patch_tables):
    """Whole table of awkward documents, with repeated and null ids."""
    return patch_tables(documents=docs)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_whole_op1(spark, awkward, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, at = [], 0
    got = queries.op1_token_planes(spark, awkward).collect()
    own = sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == own
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, queries.END_ID]
        want.append((d, len(ids), crc(ids)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)


def test_whole_op3(spark, awkward, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > queries.TOKEN_LIMIT) for d, t, *_ in rows]
    got = [tuple(r) for r in queries.op3_digest_cache(spark, awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op3_second_load_encodes_misses_only(spark, tmp_path):
    cache, model = f"file://{tmp_path}/cache", P.path("piece_bpe_32k.model")
    loads = [[(1, "a b"), (2, "c"), (3, None)], [(4, "a b"), (5, "new text"), (6, "")]]
    sizes = []
    for rows in loads:
        out = digest_cache.count_tokens(spark.createDataFrame(rows, DOCS), model, 4096, cache)
        assert out.count() == 3
        sizes.append(spark.read.parquet(cache).count())
    assert sizes == [3, 4]


def test_whole_op8(spark, awkward, rows):
    import tiktoken

    from textloom.llm import byte_bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(x := enc.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for d, t, *_ in rows]
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op8_byte_bpe(spark, awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op2_uses_every_letter():
    long = "x" * 60
    a, b = language.features(long + "abc" + long), language.features(long + "abd" + long)
    assert set(a) != set(b) and set(language.features(long + "ing")) & set(language.features("thing"))


def test_samples_take_a_repeated_text_once(spark):
    docs = spark.createDataFrame([(1, "good words here", "en")] * 50 + [(2, "vile scum", "en"), (2, "another text of it", "en"), (3, None, "en"), (4, "bon mot", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert sorted(y for y, _ in got) == [0, 0, 1]
    assert sorted(x for x, _ in language.training_texts(docs, F.lit(True))) == ["en", "en", "en", "fr"]


def test_sample_is_bounded_by_characters(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "word " * 20) for i in range(30)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1000)
    assert len(toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 20)) == 10


def test_names_of_results_win(spark):
    docs = spark.createDataFrame([(1, "some words of a text", 5, "x", 0.25)], "doc_id long, text string, n_hit int, items string, score double")
    out = decontaminate.contamination(docs, spark.createDataFrame([(1, "some words")], "item_id long, text string"), keep=["doc_id", "items", "n_hit"])
    assert out.columns == ["doc_id", "n_words", "n_hit", "spans", "items", "contaminated"] and out.first()["items"] == ["1"]
    out = toxicity.score(docs, {1 << toxicity.BITS: 0.0}, ["doc_id", "score"])
    assert out.columns == ["doc_id", "score"] and out.first()["score"] == 0.5


def test_op4_owns_members_with_whole_headers_only():
    import io

    good = warc.record(1, "http://a", b"<html>")
    bad = [warc.zlib.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", wbits=31), warc.zlib.compress(b"WARC/1.x\r\n\r\n", wbits=31), warc.zlib.compress(b"WARC/1.1\r\nno colon\r\n\r\n", wbits=31), warc.MAGIC + b"junk"]

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    for x in bad:
        f = File(x + good)
        assert [at for at, _ in warc.RangeReader(f, 0, f.size())] == [len(x)]


def test_op4_repeated_rows(spark):
    rows = [(1, "u", "x"), (7, "b", "x"), (7, "a", "x"), (7, "a", "x"), (None, "u", "x"), (None, None, "y"), (None, None, "y"), (2, None, None), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.write_warc(pages)).collect()]
    want = [(1, "revisit", 7), (7, "revisit", 7), (7, "revisit", 7), (7, "response", None), (None, "revisit", 7), (None, "response", None), (None, "response", None), (2, "revisit", 3), (3, "response", None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
