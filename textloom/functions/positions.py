"""Sites, lines and positions. Only a newline starts a line and belongs to the line it ends; lines and columns are
1-based, sites 0-based code points; out-of-range values clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """line rows: doc_id, line, start, end (end without the next line's start), string without its newline."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "string"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("start", F.coalesce(F.sum(F.length("string") + 1).over(before), F.lit(0)).cast("long"))
    return p.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "start", (F.col("start") + F.length("string")).alias("end"), "string")


def line_starts(text: Column) -> Column:
    """Starts of a text's lines as an array."""
    parts = F.split(text, "\n", -1)
    sums = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    return F.slice(sums, 1, F.size(parts))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_of(text: Column, site: Column) -> Column:
    """Line of a site: newlines before it, and one."""
    return line_count(F.substring(text, F.lit(1), _clamp(text, site)))


def column_of(text: Column, site: Column) -> Column:
    before = F.substring(text, F.lit(1), _clamp(text, site))
    return (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long")


def site_of(text: Column, line: Column, column: Column) -> Column:
    """Site of a position; line and column clamp to the text and the line."""
    n = line_count(text)
    line = F.greatest(F.lit(1), F.least(line, n)).cast("int")
    before = F.call_function("substring_index", text, F.lit("\n"), line - 1)
    start = F.when(line == 1, 0).otherwise(F.length(before) + 1)
    own = F.element_at(F.split(text, "\n", -1), line)
    last = F.when(line == n, F.length(own)).otherwise(F.length(own) + 1)  # the line's end is the next line's start
    return (start + F.greatest(F.lit(0), F.least(column - 1, last))).cast("long")


def byte_index(text: Column, site: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), _clamp(text, site))).cast("long")


def substring_span(text: Column, start: Column, end: Column) -> Column:
    """Characters of [start, end), clamped."""
    a = _clamp(text, start)
    return F.substring(text, a + 1, F.greatest(F.lit(0), _clamp(text, end) - a))


def valid_span(text: Column, start: Column, end: Column) -> Column:
    return (start >= 0) & (start <= end)


def chars(docs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Characters of a span of each text, one row each with their site."""
    first = _clamp(F.col("text"), start).alias("first")
    p = docs.select("doc_id", first, F.posexplode(F.split(substring_span(F.col("text"), start, end), "")).alias("i", "char"))
    return p.where(F.col("char") != "").select("doc_id", (F.col("first") + F.col("i")).cast("long").alias("site"), "char")


def _clamp(text: Column, site: Column) -> Column:
    return F.greatest(F.lit(0), F.least(site, F.length(text))).cast("int")
