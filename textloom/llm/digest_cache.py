"""Token counts by a digest cache (operator 3).

The cache is a table (content digest, tokenizer-version digest, n_tokens) in Parquet. A call normalises each content
(null becomes the empty text; nothing else is changed, for white space and letter case matter to the count), digests
it, joins the cache, encodes only distinct misses, appends them, and joins again to answer. The tokenizer's digest
covers the bytes of its file and the version of this module's counting rule.

Defined results: null text counts as empty: 0 bytes and 0 tokens; repeated rows and ids get a row each; an empty table
gives no rows; extra columns are not read. Lost executors: the cache is appended by Spark's committed writes; a
duplicate entry after a crash is harmless, for entries are reduced to one per digest.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, lookup, scratch, small_batches, texts_of, written

RULE = b"count-v1"
ENTRY = "digest binary, tokenizer binary, n_tokens long"
CACHE_BYTES = 96 << 20


def tokenizer_digest(path: str) -> bytes:
    """Digest of a tokenizer's version: its file and the counting rule."""
    with open(path, "rb") as f:
        return hashlib.sha256(RULE + f.read()).digest()[:16]


@lru_cache(maxsize=2)
def counter(path: str):
    """texts -> token counts, as the file's library gives them."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding(), tok.no_truncation()
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    # Merges can't reach over the start of a word if no piece has the space mark after another character, the
    # normaliser leaves texts alone and a mark is put before each text: then words are counted apart, once each.
    apart = all(re.fullmatch("▁*[^▁]*", p) for p in pieces) and len(sp.encode("ﬁ  x Å ")) == len(sp.encode("ﬁ  x Å")) + 1
    apart = apart and sp.encode("a", out_type=str)[0].startswith("▁") and sp.decode(sp.encode("ﬁ")) == "ﬁ"
    if not apart:
        return whole
    memo: dict[str, int] = {}
    held = [0]

    def count(texts: list[str]) -> list[int]:
        if held[0] > CACHE_BYTES:
            memo.clear()
            held[0] = 0
        odd = {i for i, t in enumerate(texts) if not t or t[0] == " " or t[-1] == " " or "  " in t or "▁" in t}
        words = [() if i in odd else t.split(" ") for i, t in enumerate(texts)]
        new = list(set().union(*words) - memo.keys())
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update(zip(part, whole(part), strict=True))
            held[0] += sum(map(len, part)) + 160 * len(part)
        out = [sum(map(memo.__getitem__, w)) for w in words]
        rest = sorted(odd)
        for i, n in zip(rest, whole([texts[i] for i in rest]) if rest else (), strict=True):
            out[i] = n
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, cache: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is the path of the cache table; by default a new one in the shared folder. The digests of all rows are
    grouped before the texts move, copies are reduced on the map side, and a hot content is answered by broadcast.
    """
    spark = attach(docs.sparkSession)
    cache = cache or scratch(spark, "token-counts")
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    stored = _entries(spark, cache, version)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in small_batches(batches, "text"):
            n = count(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.binary()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    # Copies are reduced to one row per digest, map side first; digests with a stored count leave by a join on the same
    # partitioning, and what is left is encoded.
    misses = rows.groupBy("digest").agg(F.min("text").alias("text"))
    if stored is not None:
        misses = misses.join(stored.select("digest"), "digest", "left_anti").select("digest", "text")
    misses.mapInArrow(encode, ENTRY).write.mode("append").option("compression", "zstd").parquet(cache)
    counts = _entries(spark, cache, version)
    # Digests and lengths alone from here on.
    slim = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    sizes = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"))
    known = sizes.join(counts, "digest", "left").select("digest", "n_rows", "n_tokens")
    out = lookup(slim, known, "digest", "n_rows", docs.count())
    # The answer is a table of its own: two plans that read one cache before and after an append look alike to Spark.
    return written(out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "counted")


def _entries(spark, cache: str, version: bytes) -> DataFrame | None:
    """One entry per digest of this tokenizer's version; None while nothing is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    got = spark.read.schema(ENTRY).parquet(cache).where(F.col("tokenizer") == F.lit(bytearray(version)))
    return got.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
