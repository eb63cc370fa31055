"""Corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents; other columns are left out.

Defined results, for every stage: an empty table gives no rows; a null or empty text has no words, so that it is clean,
loses no lines, is nobody's copy and has no tokens; rows are judged by their own text, whatever their id, be it null or
repeated; rows that repeat in id and text fare alike until near-dedup, which keeps one of them. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, decontaminate, line_dedup, near_dup, toxicity
from textloom.llm.common import save, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic (score of 0.5 or more). Without labelled rows none goes."""
    weights = toxicity.model_of(docs, table(spark, sf_dir, "labels"))
    if not weights:
        return docs.select(*COLUMNS)
    return toxicity.score(docs, weights, COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that occurred earlier up to one edit, or, if short, as they are. A document of which nothing but
    blank lines is left goes; one that lost no line stays as it is. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, short_copies=True)
    lost = F.size("dropped") > 0
    empty = lost & (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) == 0)
    out = out.where(~empty).withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest id, then the smallest digest of its text.
    Shingles of five words, a similarity of 0.8. Rows are told apart by id and text, so that rows of one id with
    different texts are judged each by its own; texts without words all stay."""
    return near_dup.keep_one(docs.select(*COLUMNS), width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark windows over a twentieth of their words or more."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids' number and the digests of ids and decoded bytes, with its language and source."""
    import public_tokenizers

    out = byte_bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokenize),
]

#: No SQL: the classifier and the tokenizer can't be expressed in it; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        save(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
