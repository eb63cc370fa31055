"""Line dedup by a deletion-neighbourhood join (operator 9).

Two lines are the same if their normal forms (trimmed, lower case) are at most one edit (insert, delete or substitute a
character) apart. A line is dropped if a line that is the same occurs earlier, in the order of doc_id, then the text's
hash, then the line's number. Lines whose normal form is shorter than ``min_chars`` are left alone, or, with
``short_copies``, dropped if an equal line that isn't blank occurs earlier: no edit is granted to them.

Each distinct line emits variants with one character deleted, and itself, as hashed keys, and equal keys meet: a line
that equals another's variant is one insertion from it; two lines that give the same variant by deleting at the same
place are one substitution apart. All lines of such a group are within one edit of each other, so each needs to meet
the group's earliest only: no pairs are made. Every pair found is verified by its edit distance.

Which variants are made follows from the pigeonhole principle: one edit falls into one part of a line, so two lines
within one edit agree in all else. First lines without one half are joined, then, for lines that share such a half with
another line, lines without one eighth of that half. A line makes the variants of those eighths alone that it shares
with another line. These joins are exact. Bloom filters of bounded size stand before the first of them and before the
last look at the corpus, and leave out lines that have no partner and no copy: where a filter is full, all distinct
lines (or all positions) go to the join behind it, which is as much as the corpus and no more.

Defined results: null and empty texts have one empty line, which stays; rows with equal doc_id and text count as one
and get equal results; null ids come first; empty tables give no rows; other columns pass through, whatever their names;
of equal lines the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sketch, attach, lookup, small_batches, texts_of, written

MIN_CHARS = 16
#: Two prime moduli below 2**31 and bases of the variants' hash: sum of c_j * base**j.
PRIMES = ((2147483629, 1000003), (2147483587, 998244353 % 2147483587))


def normal(line: str) -> str:
    return line.strip().lower()


def grids(n: int) -> tuple[int, ...]:
    """Lengths L <= n by which a line of n characters is parted. Lines of n and n + 1 characters have one in common."""
    if n <= 64:
        return (n, n - 1) if n > 1 else (n,)
    own = n // 32 * 32
    return (own, own - 32) if n % 32 == 0 else (own,)


def part_keys(line: str, parts: int, wanted: list[tuple[int, int]] | None = None, lengths: tuple[int, ...] = (0,)) -> list[tuple[int, int, int]]:
    """(hash, grid, part): the line without one of its parts, what is before it counted from the line's beginning and
    what is after it from its end. One edit falls into one part, so that two lines within one edit share a key.
    ``wanted`` names the (grid, part) to make, all by default. ``lengths`` adds a length to the keys: (0, 1) parts lines
    whose lengths differ by more than one."""
    n = len(line)
    raw = line.encode("utf-32-le", "surrogatepass")
    own = grids(n)
    out = []
    for g, j in wanted if wanted is not None else [(g, j) for g in range(len(own)) for j in range(parts)]:
        begin, end = part_span(n, parts, g, j)
        head = xxhash.xxh3_64_intdigest(raw[: 4 * begin], own[g] * 64 + j)
        both = xxhash.xxh3_64_intdigest(raw[4 * end :], head)
        out += [(both if lengths == (0,) else xxhash.xxh3_64_intdigest((n + k).to_bytes(8), both), g, j) for k in lengths]
    return out


def part_span(n: int, parts: int, g: int, j: int) -> tuple[int, int]:
    """Where part ``j`` of grid ``g`` begins and ends in a line of n characters."""
    length = grids(n)[g]
    return length * j // parts, n - (length - length * (j + 1) // parts)


def half_keys(line: str) -> list[tuple[int, int, int]]:
    return part_keys(line, 2)


def eighth_keys(line: str, halves: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Keys of the eighths that lie in the given halves (grid, half)."""
    return part_keys(line, 8, [(g, 4 * j + i) for g, j in halves for i in range(4)], (0, 1))


def digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    p, step = np.uint64(prime), base % prime
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % p])
        step = step * step % prime
    return out[:n]


_TABLES: dict[int, tuple[np.ndarray, int]] = {}


def _table(k: int, n: int) -> tuple[np.ndarray, int]:
    prime, base = PRIMES[k]
    if k not in _TABLES or len(_TABLES[k][0]) < n:
        _TABLES[k] = (_powers(base, prime, max(4096, n)), pow(base, -1, prime))
    powers, inverse = _TABLES[k]
    return powers[:n], inverse


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without character i for each i: prefix sums make them all in one go."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    own, cut = 0, np.zeros(n, np.uint64)
    for k, (prime, _) in enumerate(PRIMES):
        p = np.uint64(prime)
        powers, inverse = _table(k, n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(c * powers % p)])
        total = sums[-1]
        after = (total - sums[1:]) % p * np.uint64(inverse) % p
        cut = (cut << np.uint64(31)) | ((sums[:-1] + after) % p)
        own = (own << 31) | int(total % p)
    return own, cut


# -- stages -----------------------------------------------------------------------------------------------------


def _lines(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows)`` over (doc_id, text hash, line number, normal form) of the lines of bounded slices of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols = fn((d, h, i, normal(x)) for d, h, t in zip(ids, hashes, texts_of(batch), strict=True) for i, x in enumerate(t.split("\n")))
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)


def _columns(rows, kinds: list) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]


MASK = (1 << 64) - 1


def line_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def distinct_lines(docs: DataFrame, min_chars: int, short_copies: bool) -> DataFrame:
    """Distinct lines: key, lid (64 bits of it), pos (of the earliest), n. Slices of texts are reduced in the kernel,
    tasks before the shuffle."""
    least = 1 if short_copies else min_chars

    def reduce(rows) -> list[pa.Array]:
        seen: dict[str, list] = {}
        for d, h, i, x in rows:
            if len(x) < least:
                continue
            at = (d is not None, d or 0, h, i)
            held = seen.get(x)
            if held is None:
                seen[x] = [at, 1]
            else:
                held[1] += 1
                if at < held[0]:
                    held[0] = at
        out = [(digest(x), at[1] if at[0] else None, at[2], at[3], n) for x, (at, n) in seen.items()]
        return _columns(out, [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])

    found = _lines(docs, reduce, "key binary, doc_id long, h long, line_no int, c long")
    return written(found.groupBy("key").agg(F.min(F.struct("doc_id", "h", "line_no")).alias("pos"), F.sum("c").alias("n")), "lines")


def half_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """key, lid and line of the distinct lines that share a half with another one, and of few others."""

    def distinct(rows) -> list[str]:
        return list(dict.fromkeys(x for *_, x in rows if len(x) >= min_chars))

    def halves(rows) -> list[pa.Array]:
        a = np.array([(k, line_id(digest(x)) & MASK) for x in distinct(rows) for k, _, _ in half_keys(x)], np.uint64).reshape(-1, 2).view(np.int64)
        return [pa.array(a[:, 0]), pa.array(a[:, 1])]

    shared = _lines(docs, halves, "part long, lid long").groupBy("part").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a <> b").select("part")
    sketch = Sketch(written(shared, "halves"), "part")

    def partners(rows) -> list[pa.Array]:
        seen = distinct(rows)
        keys = [[k for k, _, _ in half_keys(x)] for x in seen]
        ok = sketch.may_hold(np.fromiter((i for x in keys for i in x), np.uint64, sum(map(len, keys))))
        ends = np.cumsum([0] + [len(x) for x in keys])
        hit = np.add.reduceat(ok, ends[:-1], dtype=np.int64) > 0 if seen else ok
        own = [(digest(x), x) for x, o in zip(seen, hit.tolist(), strict=True) if o]
        return _columns([(k, line_id(k), x) for k, x in own], [pa.binary(), pa.int64(), pa.string()])

    found = _lines(docs, partners, "key binary, lid long, line string")
    return written(found.groupBy("key").agg(F.first("lid").alias("lid"), F.first("line").alias("line")), "half-lines")


def _shared_parts(lines: DataFrame, keys, name: str) -> DataFrame:
    """(lid, marks): for lines that share a key with another line the places (grid, part) of the keys shared.
    ``keys(batch)`` gives (key, lid, grid, part) of a batch of ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "line", 1 << 20):
            a = np.array(keys(batch), object).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].astype(np.uint64).view(np.int64)), pa.array(a[:, 1].astype(np.int64)), pa.array(a[:, 2].astype(np.int32)), pa.array(a[:, 3].astype(np.int32))], ["part", "lid", "g", "j"])

    entries = written(lines.mapInArrow(run, "part long, lid long, g int, j int"), name)
    shared = entries.groupBy("part").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a <> b").select("part")
    return entries.join(shared, "part", "left_semi").groupBy("lid").agg(F.collect_set(F.struct("g", "j")).alias("marks"))


def _of_halves(batch: pa.RecordBatch) -> list:
    return [(k, lid, g, j) for lid, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, g, j in half_keys(x)]


def _of_eighths(batch: pa.RecordBatch) -> list:
    cols = (batch.column(c).to_pylist() for c in range(3))
    return [(k, lid, g, j) for lid, x, marks in zip(*cols, strict=True) for k, g, j in eighth_keys(x, [(m["g"], m["j"]) for m in marks])]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line itself (at -1) and the variants by a deletion in one of its marked eighths."""
    for batch in small_batches(batches, "line", 1 << 17):
        v, at, where = [], [], []
        for i, (line, marks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            own, cut = variant_hashes(line)
            spans = [np.arange(*part_span(len(line), 8, m["g"], m["j"])) for m in marks]
            places = np.unique(np.concatenate(spans))
            v += [np.array([own], np.uint64), cut[places]]
            at += [[-1], places]
            where.append(np.full(len(places) + 1, i))
        if v:
            owner = pa.array(np.concatenate(where))
            rest = [batch.column(i).take(owner) for i in range(2, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), *rest], ["v", "at", "lid", "doc_id", "h", "line_no"])


def near_keys(docs: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """Keys of the lines that have an earlier line within one edit: exact."""
    lines = half_lines(docs, min_chars)
    marked = written(lines.join(_shared_parts(lines.select("lid", "line"), _of_halves, "halves"), "lid"), "marked")
    finer = _shared_parts(marked.select("lid", "line", "marks"), _of_eighths, "eighths")
    lines = written(marked.drop("marks").join(finer, "lid").join(distinct.select("key", "pos"), "key"), "eighth-lines")
    # ``at`` is the deleted place, -1 for the line itself. Deleting any of equal neighbours gives one variant; all places
    # are kept, for the partner may name another of them.
    own = lines.select("line", "marks", "lid", "pos.doc_id", "pos.h", "pos.line_no")
    entries = written(own.mapInArrow(_variants, "v long, at int, lid long, doc_id long, h long, line_no int").select("v", "at", "lid", F.struct("doc_id", "h", "line_no").alias("pos")), "variants")
    earliest = F.min(F.struct("pos", "lid")).alias("first")
    itself, cuts = entries.where("at < 0"), entries.where("at >= 0")
    substituted = _meet(cuts, cuts.groupBy("v", "at").agg(earliest), ["v", "at"])
    inserted = _meet(cuts, itself.groupBy("v").agg(earliest), ["v"]).unionByName(_meet(itself, cuts.groupBy("v").agg(earliest), ["v"]))
    pairs = substituted.unionByName(inserted).distinct()
    # Each pair is verified by its edit distance, so that equal hashes of other lines hide nothing.
    x = lines.select("lid", "key", "line", "pos")
    y = lines.select(F.col("lid").alias("other"), F.col("line").alias("other_line"), F.col("pos").alias("other_pos"))
    checked = pairs.join(x, "lid").join(y, "other").where((F.col("other_pos") < F.col("pos")) & (F.levenshtein("line", "other_line", 1) >= 0))
    return written(checked.select("key").distinct(), "near")


def _meet(entries: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Each entry with the earliest line of its group, where that is another and earlier line. Groups have one row per
    key, so the join doesn't multiply rows."""
    met = entries.select(*on, "lid", "pos").join(groups.select(*on, "first"), on)
    return met.where((F.col("first.pos") < F.col("pos")) & (F.col("first.lid") != F.col("lid"))).select("lid", F.col("first.lid").alias("other"))


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """Occurrences to drop: doc_id, h (hash of the text), line_no."""
    attach(docs.sparkSession)
    distinct = distinct_lines(docs, min_chars, short_copies)
    near = near_keys(docs, distinct, min_chars).withColumn("near", F.lit(True))
    # Occurrences of lines that occur again, or have an earlier partner.
    repeated = distinct.join(near, "key", "left").where(F.coalesce("near", F.lit(False)) | (F.col("n") > 1))
    repeated = written(repeated.select("key", "pos", "n", F.coalesce("near", F.lit(False)).alias("near")), "repeated")
    again = Sketch(repeated.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("lid")), "lid")
    least = 1 if short_copies else min_chars

    def candidates(rows) -> list[pa.Array]:
        own = [x for x in rows if len(x[3]) >= least]
        keys = {x: digest(x) for x in {x[3] for x in own}}
        names = list(keys)
        ok = again.may_hold(np.fromiter((line_id(keys[x]) for x in names), np.int64, len(names)))
        held = {x for x, o in zip(names, ok.tolist(), strict=True) if o}
        return _columns([(keys[x], d, h, i) for d, h, i, x in own if x in held], [pa.binary(), pa.int64(), pa.int64(), pa.int32()])

    found = _lines(docs, candidates, "key binary, doc_id long, h long, line_no int")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = lookup(found, repeated, "key", "n", total).where(F.col("near").isNotNull())
    later = ~F.struct("doc_id", "h", "line_no").eqNullSafe(F.col("pos"))
    return found.where(F.col("near") | later).select("doc_id", "h", "line_no")


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which lines go, by number, up to the last one that does."""
    for batch in batches:
        out = []
        for gone in batch.column(2).to_pylist():
            mask = np.zeros(gone[-1] + 1, bool)
            mask[gone] = True
            out.append(mask)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.bool_()))], ["__id", "__h", "__gone", "__mask"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """``docs`` with the text without the dropped lines, and ``dropped``, the numbers of those lines (ascending, from
    0). A column of that name in ``docs`` is replaced."""
    drops = near_lines(docs, min_chars, short_copies).groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_set("line_no")).alias("__gone"))
    drops = drops.mapInArrow(_masks, "__id long, __h long, __gone array<int>, __mask array<boolean>")
    kept = [c for c in docs.columns if c.lower() != "dropped"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], F.col("doc_id").cast("long").alias("__d"), F.col("text").cast("string").alias("__t"))
    out = rows.join(drops, F.col("__d").eqNullSafe(F.col("__id")) & (F.xxhash64("__t") == F.col("__h")), "left")
    lines = F.zip_with(F.split(F.col("__t"), "\n", -1), "__mask", lambda x, gone: F.when(~F.coalesce(gone, F.lit(False)), x))
    text = F.when(F.col("__gone").isNull(), F.col("__t")).otherwise(F.concat_ws("\n", F.filter(lines, lambda x: x.isNotNull())))
    cols = [text.alias(c) if c == "text" else F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*cols, F.coalesce("__gone", F.array().cast("array<int>")).alias("dropped"))
