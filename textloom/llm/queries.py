"""Queries of the ten operators; each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, digest_cache, iso_media, language, line_dedup, near_dup, oracles, token_planes, toxicity, warc
from .common import crc32_of_id, scratch, table

END_ID = 2
TOKEN_LIMIT = 4096


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_planes.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_planes.read_tokens(index)


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.learned(docs))
    return out.select("doc_id", (crc32_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op3_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two loads, as to a cache that lives on: texts of the second that the first held find their
    counts stored. Both loads together are the whole table."""
    docs, cache, out = table(spark, sf_dir, "documents"), scratch(spark, "token-counts"), []
    early = F.coalesce(F.xxhash64("doc_id") < 0, F.lit(True))
    for load in (docs.where(early), docs.where(~early)):
        out.append(digest_cache.count_tokens(load, public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT, cache))
    return out[0].unionByName(out[1])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_media.media_features(iso_media.media_table(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.model_of(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, weights, ["doc_id"])
    return out.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines, the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.dedup_lines(docs.select("doc_id", "text"), short_copies=True)
    n = F.size("dropped")
    left = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # A text that lost all its lines is empty, not one empty line.
    return out.select("doc_id", n.cast("long").alias("n_dropped"), F.when((n > 0) & (F.coalesce("text", F.lit("")) == ""), 0).otherwise(left).cast("long").alias("n_kept_or_blank"), F.array_join("dropped", ",").alias("dropped_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classify(table(spark, sf_dir, "documents"), width=2)


QUERIES = {f.__name__: f for f in (op1_token_planes, op2_language_crf, op3_digest_cache, op4_warc, op5_iso_media, op6_decontamination, op7_toxicity, op8_byte_bpe, op9_line_dedup, op10_minhash)}

#: The others have no SQL: their tokenizers, models and file formats are tested by brute force and round trips.
ORACLES = {"op4_warc": oracles.WARC, "op6_decontamination": oracles.DECONTAMINATION, "op9_line_dedup": oracles.LINES, "op10_minhash": oracles.NEAR}
