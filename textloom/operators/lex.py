"""Tokens of documents: the automaton kernel over Arrow batches, and the SQL path for grammars with a pattern.

Both give ``tok`` rows: doc_id, tok_idx, rule, name, string, start, length, byte_start. Sites are 0-based code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach

TOK = "doc_id long, tok_idx int, rule int, name string, string string, start int, length int, byte_start int"


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows and ``size`` bytes at most (or one row) bound what a kernel holds at once."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield b.slice(at, n)
            at += n


def byte_starts(text: str, starts: np.ndarray) -> np.ndarray:
    """UTF-8 offsets of sites."""
    if text.isascii():
        return starts
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    width = 1 + (c > 0x7F).astype(np.int32) + (c > 0x7FF) + (c > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])[starts]


def lex(docs: DataFrame, grammar, columns: tuple[str, ...] | None = None, automaton: bool = False) -> DataFrame:
    """Tokens by the grammar's scanner; a null text has none. Only ``columns`` of the rows leave the kernel (all by
    default). ``automaton`` scans by the automaton even where the grammar has patterns for the regular-expression search."""
    attach(docs.sparkSession)
    fields = [x.split() for x in TOK.split(", ")]
    fields = [(n, t) for n, t in fields if columns is None or n in columns]
    asked = {n for n, _ in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(grammar, automaton)
        names = pa.array(grammar.names, pa.string())
        for batch in slices(batches):
            parts: dict[str, list] = {n: [] for n in asked | {"rule"}}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rule, start, length = scan(text or "")
                parts["rule"].append(rule)
                if "doc_id" in asked:
                    parts["doc_id"] += [doc] * len(rule)
                if "tok_idx" in asked:
                    parts["tok_idx"].append(np.arange(len(rule), dtype=np.int32))
                if "start" in asked:
                    parts["start"].append(start)
                if "length" in asked:
                    parts["length"].append(length)
                if "string" in asked:
                    parts["string"] += [text[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                if "byte_start" in asked and text:
                    parts["byte_start"].append(byte_starts(text, start))
            rules = np.concatenate(parts["rule"])
            cols = []
            for n, t in fields:
                if n == "name":
                    cols.append(names.take(pa.array(rules)))
                elif n in ("doc_id", "string"):
                    cols.append(pa.array(parts[n], KINDS[t]))
                else:
                    x = parts[n]
                    cols.append(pa.array(np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays(cols, [n for n, _ in fields])

    schema = ", ".join(f"{n} {t}" for n, t in fields)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _scanner(grammar, automaton: bool = False):
    """A function from a text to the rules, starts and lengths of its tokens, as arrays."""
    if not automaton and hasattr(grammar, "arrays"):
        return grammar.arrays
    scan = grammar.scan_states if automaton else grammar.scan
    return lambda text: np.array(list(scan(text)), np.int32).reshape(-1, 3).T


def token_counts(docs: DataFrame, grammar, automaton: bool = False) -> DataFrame:
    """Tokens of all texts by rule name: name, n, chars. The kernel adds up each slice before rows leave it, so that the
    shuffle gets a row per slice and rule instead of one per token."""
    attach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(grammar, automaton)
        names, width = pa.array(grammar.names, pa.string()), len(grammar.names)
        for batch in slices(batches):
            n, chars = np.zeros(width, np.int64), np.zeros(width, np.int64)
            for text in batch.column(0).to_pylist():
                rule, _, length = scan(text or "")
                n += np.bincount(rule, minlength=width)
                chars += np.bincount(rule, length, width).astype(np.int64)
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(there)), pa.array(n[there]), pa.array(chars[there])], ["name", "n", "chars"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "name string, n long, chars long")
    return parts.groupBy("name").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def token_name(piece: Column, names: dict[str, str]) -> Column:
    """Name of a token by its text: the first pattern (Java regular expression) that matches all of it."""
    out = F.lit("Mismatch")
    for name, pattern in reversed(names.items()):
        out = F.when(piece.rlike(f"^(?s:{pattern})$"), name).otherwise(out)
    return out


def lex_sql(docs: DataFrame, pattern: str, names: dict[str, str]) -> DataFrame:
    """The same by Catalyst alone: one regular expression gives the tokens in order, runs in which none starts as one
    piece, so that names and lengths need no shuffle; sites, if asked for, are a running sum per document. Only for
    grammars where leftmost-first search gives the longest match."""
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)({pattern}|(?:(?!(?:{pattern})).)++)"), F.lit(1))
    p = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(pieces).alias("tok_idx", "string"))
    before = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("string")).over(before), F.lit(0))
    byte = F.coalesce(F.sum(F.octet_length("string")).over(before), F.lit(0))
    return p.select("doc_id", "tok_idx", token_name(F.col("string"), names).alias("name"), "string", start.cast("int").alias("start"), F.length("string").alias("length"), byte.cast("int").alias("byte_start"))


def lookahead(tok: DataFrame, distance: int = 1, column: str = "name") -> Column:
    """``column`` of the token ``distance`` after (negative: before) each token; null beyond the ends."""
    by = Window.partitionBy("doc_id").orderBy("tok_idx")
    return F.lead(column, distance).over(by) if distance >= 0 else F.lag(column, -distance).over(by)


def chunks(tok: DataFrame, start: int, end: int) -> DataFrame:
    """Tokens that a span touches."""
    return tok.where((F.col("start") < end) & (F.col("start") + F.col("length") > start))


def token_at(tok: DataFrame, sites: DataFrame) -> DataFrame:
    """The token that holds each site of ``sites`` (doc_id, site): the last one that starts at or before it, found by one
    pass in order over the document's tokens and sites. None from the end on."""
    names = [c for c in tok.columns if c != "doc_id"]
    extra = [c for c in sites.columns if c != "doc_id"]
    t = tok.select("doc_id", F.col("start").cast("long").alias("__at"), F.lit(0).alias("__side"), F.struct(*names).alias("__t"))
    s = sites.select("doc_id", F.col("site").cast("long").alias("__at"), F.lit(1).alias("__side"), F.struct(*extra).alias("__s"))
    by = Window.partitionBy("doc_id").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = t.unionByName(s, allowMissingColumns=True).withColumn("__t", F.last("__t", ignorenulls=True).over(by)).where("__side = 1")
    inside = F.col("__at") < F.col("__t.start") + F.col("__t.length")
    return met.select("doc_id", "__s.*", *[F.when(inside, F.col(f"__t.{c}")).alias(c) for c in names])


def token_streams_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents whose token streams (tok_idx, name, string) differ: doc_id, first_diff (the first place), n_diff."""
    x, y = (t.select("doc_id", "tok_idx", F.struct("name", "string").alias(c)) for t, c in ((a, "x"), (b, "y")))
    both = x.join(y, ["doc_id", "tok_idx"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.groupBy("doc_id").agg(F.min("tok_idx").alias("first_diff"), F.count(F.lit(1)).alias("n_diff"))


def join_parts(parts: DataFrame) -> DataFrame:
    """Texts from parts (doc_id, part, text), in order: lexing the whole gives what appending part by part gives."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return parts.groupBy("doc_id").agg(F.array_join(ordered, "").alias("text"))
