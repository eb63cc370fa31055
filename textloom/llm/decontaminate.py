"""Benchmark decontamination by a prefix-filtered set join (operator 6).

Items are cut into windows of ``width`` consecutive words (an item of fewer, but some, is one window). A window is
contained in a document only if all its words are; for full containment the necessary prefix in the order of rarity is
one token. So windows are indexed by their rarest word (document frequency over the whole corpus, then the word's
bytes), together with the position of that word in the window: a document position that holds the word admits exactly
the windows that start that far before it (positional bound) and end inside the document (length bound). Each admitted
run of words is verified by equality, over windows of the item's size.

Words: A-Z are lower-cased, then maximal runs of characters other than U+0000-002F, U+003A-0060 and U+007B-007F. All
separators are ASCII, so the split works on UTF-8 bytes.

Word frequencies are counted in one scan of the documents, for the words of all items, and kept as a table. Items are
taken in blocks of bounded size (BLOCK_WORDS words; a longer item is cut into overlapping pieces), each block's index
broadcast to one scan of the documents; each block's scan merges its hits into those of the blocks before. Benchmarks of
up to BLOCK_WORDS words take two scans in all, larger ones a scan per block more. Documents are never broadcast.

Defined results: null text or item has no words, an empty table of items leaves all documents clean, an empty table of
documents gives no rows. Rows of one item_id count as one item; null item_ids are left out. Repeated documents get a
row each. An item's windows that overlap hit each document word once.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Sketch, attach, small_batches, written

WIDTH = 13
#: A block's index and the next block's items are what the driver holds and broadcasts: some 100 MB at most.
BLOCK_WORDS = 250_000
COUNTED = 200_000
#: Lower case, and a space for each separator.
WORDS = bytes(LOWER[c] if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


def item_windows(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class WindowIndex:
    """Windows of some items by their rarest word."""

    def __init__(self, items: list[tuple[object, str | None]], rarity: dict[bytes, int], width: int = WIDTH):
        self.windows: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            for w in item_windows(text, width):
                self.windows[w].add(item)
        self.by_token: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for w in self.windows:
            rare = min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i))
            self.by_token[w[rare]].add((rare, len(w)))

    def search(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, and the items of the windows that occur."""
        if self.by_token.keys().isdisjoint(doc):
            return [], set()
        starts: set[tuple[int, int]] = set()
        items: set = set()
        get = self.by_token.get
        for at, token in enumerate(doc):
            for offset, n in get(token, ()):
                begin = at - offset
                if begin < 0 or begin + n > len(doc):
                    continue
                found = self.windows.get(tuple(doc[begin : begin + n]))
                if found:
                    starts.add((begin, begin + n))
                    items |= found
        return merged(starts), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_table(texts: DataFrame, only: Sketch | None = None) -> DataFrame:
    """(word, n): rows that hold each word, or each word that may be in ``only``. A task's counts are given out when they
    reach COUNTED words."""

    def counts(n: Counter) -> pa.RecordBatch:
        names = list(n)
        if only is not None and names:
            ok = only.may_hold(np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names)))
            names = [w for w, o in zip(names, ok.tolist(), strict=True) if o]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n[w] for w in names], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in small_batches(batches, "text", 4 << 20):
            for t in batch.column(0).to_pylist():
                n.update(set(words(t)))
            if len(n) > COUNTED:
                yield counts(n)
                n = Counter()
        yield counts(n)

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def token_frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(word, n): documents of the whole corpus that hold each word of the items. The items' words reach the scan as a
    filter of bounded size; the join behind it is exact."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.array([xxhash.xxh64_intdigest(w) for w in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k.view(np.int64))], ["word", "k"])

    vocabulary = written(word_table(items).select("word").mapInArrow(keyed, "word binary, k long"), "vocabulary")
    return written(word_table(docs, Sketch(vocabulary, "k")).join(vocabulary.select("word"), "word", "left_semi"), "frequencies")


def of_words(frequencies: DataFrame, block: list[tuple[object, str]]) -> dict[bytes, int]:
    """The frequencies of a block's words."""
    vocabulary = {w for _, t in block for w in words(t)}
    if not vocabulary:
        return {}
    wanted = frequencies.sparkSession.createDataFrame([(bytearray(w),) for w in vocabulary], "word binary")
    return {bytes(r["word"]): r["n"] for r in frequencies.join(wanted, "word", "left_semi").collect()}


def pieces(text: str, limit: int, width: int) -> Iterator[str]:
    """A text's words in pieces of ``limit`` that overlap by ``width - 1``, so that no window is lost or new."""
    w = words(text)
    for i in range(0, max(1, len(w) - width + 1), limit):
        yield b" ".join(w[i : i + limit + width - 1]).decode()


def item_blocks(items: DataFrame, limit: int, width: int) -> Iterator[list[tuple[object, str]]]:
    """Items (or pieces of long ones) by blocks of about ``limit`` words, one block in the driver's memory at a time."""
    block, held = [], 0
    for row in items.toLocalIterator():
        for part in pieces(row["text"], limit, width):
            block.append((row["item_id"], part))
            held += part.count(" ") + 1
            if held >= limit:
                yield block
                block, held = [], 0
    if block:
        yield block


SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
HITS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
SPANS_ARROW = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default doc_id; those named like a result column give way to it) with n_words, n_hit, spans of hit words, items (ids as strings,
    sorted) and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    spark = attach(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    n_kept = len(keep)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))

    def scan(rows: DataFrame, index: WindowIndex, last: bool) -> DataFrame:
        """One block against all rows; spans and items of earlier blocks are merged in. The text goes on to the next
        block and is left out by the last."""
        shared = spark.sparkContext.broadcast(index)
        n_out = n_kept if last else n_kept + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = shared.value.search
            for batch in small_batches(batches, "text", 4 << 20):
                n, hit, spans, items = [], [], [], []
                before = [batch.column(i).to_pylist() for i in range(n_kept + 3, n_kept + 5)] if batch.num_columns > n_kept + 1 else None
                for k, t in enumerate(batch.column(n_kept).to_pylist()):
                    w = words(t)
                    s, i = find(w)
                    i = set(map(str, i))
                    if before:
                        s = merged([*s, *((x["a"], x["b"]) for x in before[0][k])])
                        i |= set(before[1][k])
                    n.append(len(w))
                    hit.append(sum(b - a for a, b in s))
                    spans.append([{"a": a, "b": b} for a, b in s])
                    items.append(sorted(i))
                cols = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_out], *cols], [*batch.schema.names[:n_out], "n_words", "n_hit", "spans", "items"])

        out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:n_out], *HITS]))
        return out if last else written(out, "contamination")

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    blocks = item_blocks(items, BLOCK_WORDS, width)
    block = next(blocks, [])
    frequencies = token_frequencies(docs, items) if block else None
    while True:
        after = next(blocks, None)
        rows = scan(rows, WindowIndex(block, of_words(frequencies, block) if block else {}, width), after is None)
        if after is None:
            break
        block = after
    own = ("n_words", "n_hit", "spans", "items", "contaminated")
    out = rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in own], *own[:-1])
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
