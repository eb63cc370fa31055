"""The pipeline against a plain version of its stages, and its edges."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from conftest_texts import sentence
from pyspark.sql import functions as F
from test_dedup import contamination, drop_lines, groups

import corpus_pipeline
from textloom.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=7):
    rng = random.Random(seed)
    items = [(i, sentence(rng, 30, 5000)) for i in range(6)]
    rows = []
    for i in range(90):
        lines = [sentence(rng, 14, 5000) for _ in range(5)]
        if i % 9 == 0:
            lines[1] = lines[1].replace(" ", " vile ", 3) + " scum moron"
        if i % 7 == 0:
            lines.insert(2, "a line that many texts of this corpus share")
        if i % 11 == 5:
            lines.append(items[i % 6][1])
        rows.append((i, "\n".join(lines)))
    # Near copies with every line changed by some words, so that they outlive line dedup.
    for k in range(5):
        w = [x.split(" ") for x in rows[20 + k][1].split("\n")]
        for x in w:
            x[3] = x[3] + "changed"
        if k % 2:
            w = [[y for x in w for y in x]]
        rows.append((200 + k, "\n".join(" ".join(x) for x in w)))
    rows += [(300, None), (301, ""), (302, rows[40][1]), (303, rows[41][1].upper()), (304, "short")]
    return items, [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]


@pytest.fixture(scope="module")
def tables(spark, patch_tables):
    items, rows = corpus()
    labels = [(d, 1, int("vile" in (t or ""))) for d, t, *_ in rows if d < 200]
    return patch_tables(documents=spark.createDataFrame(rows, DOCS), benchmark=spark.createDataFrame(items, "item_id long, text string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_pipeline_equals_plain_stages(spark, tables):
    import tiktoken

    items, rows = corpus()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    weights = toxicity.model_of(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    bias = 1 << toxicity.BITS

    def clean(t):
        x = np.unique(toxicity.feature_ids(t or ""))
        return weights.get(bias, 0.0) + sum(weights.get(int(i), 0.0) for i in x) < 0

    kept = [(d, t) for d, t, *_ in rows if clean(t)]
    assert {d for d, t, *_ in rows if d < 200 and "vile" in t}.isdisjoint(d for d, _ in kept) and len(kept) > 80
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    drops = drop_lines([(d, hashes[d], t) for d, t in kept])
    after = []
    for d, t in kept:
        gone = drops.get((d, hashes[d]), [])
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t
        if not gone or left.strip():
            after.append((d, left))
    assert {302, 303}.isdisjoint(d for d, _ in after)
    after = one_of_each(after)
    after = [(d, t) for d, t in after if not contamination(t, items)[3]]
    from textloom.llm import byte_bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((d, len(x := enc.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for d, t in after)
    got = corpus_pipeline.run(spark, tables)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
    assert 60 < len(want) < len(rows) - 10


def one_of_each(rows):
    """rows (id, text) by brute force: of each component that with the smallest id, then text digest; equal rows once."""
    best, free = {}, []
    for (d, t), c in zip(rows, groups(rows, 5), strict=True):
        if c is None:
            free.append((d, t))
            continue
        key = (d is None, d or 0, hashlib.md5(t.encode()).digest())
        if c not in best or key < best[c][0]:
            best[c] = (key, (d, t))
    return free + [r for _, r in best.values()]


REPEATED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_near_stage_tells_rows_of_one_id_apart(spark):
    """Ids repeat over different texts: each row is judged by its own text, and one row of each group stays."""
    a, b = REPEATED, " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, b), (5, a), (9, b + " more"), (9, b + " more"), (9, "its own text that nobody else has here"), (None, a), (None, "another text without an id of its own"), (7, None), (7, ""), (3, a.upper()), (3, "short"), (3, "short")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    key = lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(one_of_each(rows), key=key)
    assert {(1, a), (5, b), (3, "short"), (9, rows[5][1]), (7, None), (7, "")} <= set(got) and len(got) == 7


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]


def test_stages_take_awkward_documents(spark, docs, no_docs, tables):
    for df in (docs.select(*corpus_pipeline.COLUMNS), no_docs.select(*corpus_pipeline.COLUMNS)):
        n = df.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, tables)
            left = out.count()
            assert left <= n and (left == n or name in ("toxicity", "line_dedup", "minhash_near_dedup")), name
    same = one_of_each([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = corpus_pipeline.drop_near_duplicates(spark, docs.select(*corpus_pipeline.COLUMNS), tables)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, same))


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
