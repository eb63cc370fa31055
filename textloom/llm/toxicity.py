"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 7).

Features of a text: its distinct hashed words, word pairs and pairs with one word between (case folded). The model is
fitted by FTRL-proximal (per-coordinate learning rates, L1 and L2) on a bounded sample of labelled rows:
``sample`` rows (default SAMPLE) with the smallest hash of their id, SAMPLE_CHARS characters at most. L1 leaves few weights; they are broadcast as
(index, weight) pairs, at most 2**BITS of them.

Defined results: a null or empty text has no features and scores by the bias; a null label teaches nothing; labels
that repeat for an id count once, 1 before 0; repeated documents get a row each; without labelled rows every score is
the neutral 0.5 and predicted 1 by the rule score >= 0.5; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, crc32_of_id, holds, small_batches, texts_of

BITS = 20
#: Labelled ids, and characters of their texts, that the model is fitted on at most.
SAMPLE, SAMPLE_CHARS = 6_000, 30_000_000
PASSES = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
MEMO_WORDS = 300_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: ASCII separators to spaces over UTF-8 bytes; other characters stay in words.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


class WordHashes:
    """64-bit hashes of words, memoised up to MEMO_WORDS words per worker."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def forget(self) -> None:
        self.memo = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def feature_ids(text: str) -> np.ndarray:
    """Hashed features of a text, repeats included: words, pairs, and pairs over one word."""
    h = HASHES.of(text.encode().translate(SPLIT).split())
    parts = [h * M1]
    if len(h) > 1:
        parts.append((h[:-1] * M2) ^ (h[1:] * M1))
    if len(h) > 2:
        parts.append((h[:-2] * M3) ^ (h[2:] * M2) ^ M1)
    x = np.concatenate(parts)
    x ^= x >> np.uint64(29)
    return ((x * M3) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; coordinate 2**BITS is the bias, without L1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1, self.bias = l1, size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example: distinct coordinates ``at``, the bias among them."""
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from, sample: int) -> list[tuple[int, np.ndarray]]:
    """(label, distinct features) of at most ``sample`` labelled ids, those with the smallest hashes, and of SAMPLE_CHARS
    characters of whole texts. Ids are cut down before they meet the texts, features are made by the executors, one text
    counts per id (that with the smallest hash): what the driver gets is bounded by these parameters."""
    attach(docs.sparkSession)
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    one = one.where(learn_from).withColumn("__h", F.xxhash64(F.lit(7), "doc_id")).orderBy("__h", "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), "label", "__h")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("text").cast("string")).alias("__t"))
    # Which text of which id, by hashes and lengths alone; at most ``sample`` rows are ranked.
    slim = rows.join(F.broadcast(one), F.col("doc_id") == F.col("__id")).groupBy("__id", "label", "__h").agg(F.min(F.struct("__t", F.length("text").alias("n"))).alias("x"))
    chars = F.sum("x.n").over(Window.orderBy("__h", "__id"))
    picked = slim.withColumn("chars", chars).where(F.col("chars") <= SAMPLE_CHARS).select("__id", "label", F.col("x.__t").alias("__p"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("toxicity", HASHES.forget)
        for batch in small_batches(batches, "text", 4 << 20):
            x = [np.unique(feature_ids(t)).astype("<i4").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["__id", "label", "x"])

    found = rows.join(F.broadcast(picked), (F.col("doc_id") == F.col("__id")) & (F.col("__t") == F.col("__p"))).select("__id", "label", "text")
    made = found.mapInArrow(make, T.StructType([T.StructField("__id", one.schema["__id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())]))
    got = made.groupBy("__id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()
    out = sorted((r["__id"], r["label"], bytes(r["x"])) for r in got)
    del got
    return [(y, np.frombuffer(x, "<i4")) for _, y, x in out]


def fit(examples: list[tuple[int, np.ndarray]], passes: int = PASSES, seed: int = 1) -> dict[int, float]:
    """Weights other than zero by coordinate; the bias is coordinate 2**BITS."""
    model = Ftrl(1 << BITS)
    order = np.arange(len(examples))
    rng = np.random.default_rng(seed)
    # A small sample is gone through more often, up to the work of 20,000 examples.
    for _ in range(max(passes, min(30, 20_000 // max(1, len(examples))))):
        rng.shuffle(order)
        for i in order:
            y, x = examples[i]
            model.learn(np.append(x, model.bias), y)
    at = np.arange((1 << BITS) + 1)
    w = model.weights(at)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def score(docs: DataFrame, weights: dict[int, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the score of each text; a column named score in ``keep`` gives way to it."""
    spark = attach(docs.sparkSession)
    shared = spark.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()))))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("__t"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("toxicity", HASHES.forget)
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        bias, slim = float(dense[-1]), dense[:-1].astype(np.float32)
        some = slim != 0
        for batch in small_batches(batches, "__t", 4 << 20):
            out = []
            for t in texts_of(batch, "__t"):
                x = feature_ids(t)
                x = np.unique(x[some[x]])
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(dense[x].sum()))))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.float64())], [*batch.schema.names[:n], "__score"])

    schema = T.StructType([*rows.schema.fields[:n], T.StructField("__score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c.lower() != "score"], F.col("__score").alias("score"))


def model_of(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict[int, float]:
    """Fitted on labelled rows whose crc32 of the id's text is not 0 modulo 5."""
    return fit(labelled_sample(docs, labels, label, crc32_of_id() % 5 != 0, sample))
