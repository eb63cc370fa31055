"""MinHash near-dedup by a multi-index Hamming join (operator 10).

A text's set: its distinct shingles of ``width`` words (A-Z lower-cased, words between ASCII white space). Texts with
equal sets form a class. Each class has a signature of COMPONENTS minhashes of 16 bits; two signatures' distance is the
number of components that differ. The signature is split into CHUNKS chunks. By the pigeonhole principle signatures
within CHUNKS * (ERRORS + 1) - 1 differing components agree in some chunk up to ERRORS components; with ERRORS = 1 a
chunk emits a key for each component left out, so any such pair shares a key. At a similarity of 0.8 that distance (27
of 64) is four standard deviations above the mean of 12.8.

Classes that share a key never meet all with all. First each class is compared with the smallest class of all its keys;
links are confirmed on full sets and joined to components. Keys that still hold classes of several components, such as
those that a passage common to unlike texts gives, are settled exactly: their classes are joined anew by the rarest
shingles of their sets (of two sets with the similarity asked for, those prefixes must meet), so that a common passage
brings nobody together; and each class that isn't of a prefix shingle's largest component is compared with the classes
that came under that component, block by block, first by signature distance, then on full sets. Every pair that shares a
key is then in one component, has been compared, or can't be similar.

Bloom filters of bounded size spare work; where one is full, at most every class (with its keys, or its set) goes to the
exact join behind it.

Defined results: null texts and texts without words have no set, are linked with nothing and are kept; a text with fewer
than ``width`` words has its whole sequence as one shingle; repeated rows have equal results; component_id is the
smallest doc_id reachable (null ids are never the smallest unless there is no other), kept is doc_id = component_id; empty
tables give no rows; other columns are not read. ``keep_one`` keeps one row of each component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Sketch, attach, batch_rows, lookup, parquet_files, save, scratch, small_batches, texts_of, written

COMPONENTS = 64
CHUNKS = 14
#: Signatures farther apart than this are not compared: the distance that the chunks guarantee.
DISTANCE = CHUNKS * 2 - 1
#: Classes in a block, on the average, and blocks of one component that a task gets.
BLOCK, TOGETHER = 128, 16
BLOCK_BYTES = 4 << 20
#: Bits of a shingle's hash by which rarity is counted: a table of 8 MB.
RARITY_BITS = 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
MULTIPLIERS = np.random.default_rng(20).integers(1 << 62, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BOUNDS = [round(i * COMPONENTS / CHUNKS) for i in range(CHUNKS + 1)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin. Arrow numbers the words of a batch, so
    that each distinct one is hashed once."""
    words = [t.encode().translate(LOWER).split() for t in texts]
    ends = np.cumsum([0] + [len(w) for w in words])
    if not ends[-1]:
        return np.empty(0, np.uint64), ends
    coded = pa.array(list(chain.from_iterable(words)), pa.large_binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()], ends


def all_shingles(texts: list[str], width: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    h, ends = word_hashes(texts)

    def rolled(h: np.ndarray, n: int) -> np.ndarray:
        x = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            x = mix(x * M2 + h[i : len(h) - n + 1 + i])
        return x

    x = rolled(h, width) if len(h) >= width else h[:0]
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        out.append(np.unique(x[a : b - width + 1]) if b - a >= width else rolled(h[a:b], b - a) if b > a else h[:0])
    return out


def shingles(text: str, width: int = 2) -> np.ndarray:
    return all_shingles([text], width)[0]


def signature(s: np.ndarray) -> np.ndarray:
    """COMPONENTS minhashes of 16 bits of a set that isn't empty."""
    best = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        best = np.minimum(best, np.multiply.outer(MULTIPLIERS, s[i : i + 2048]).min(axis=1))
    return (mix(best) >> np.uint64(48)).astype("<u2")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows x COMPONENTS): per chunk, a hash of it without each one of its components."""
    out = []
    x = sig.astype(np.uint64)
    for c in range(CHUNKS):
        places = range(BOUNDS[c], BOUNDS[c + 1])
        for gap in places:
            k = np.full(len(x), gap, np.uint64)
            for p in places:
                if p != gap:
                    k = mix(k * M2 + x[:, p] + np.uint64(1))
            out.append(k)
    return np.stack(out, axis=1)


# -- components -------------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (smallest node reachable) over undirected links, by contraction: each round every node is mapped to its
    smallest neighbour or itself, and links are redrawn between the targets, until none is left."""
    edges = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "links")
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "step")
        maps.append(step)
        n = step.count()
        ends = lookup_many(edges, step, "a", n)
        ends = lookup_many(ends.select(F.col("to").alias("x"), "b"), step, "b", n)
        edges = written(ends.select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).where("a <> b").distinct(), "links")
    if not maps:
        return links.sparkSession.createDataFrame([], f"node {links.schema[a].dataType.simpleString()}, label {links.schema[a].dataType.simpleString()}")
    # From the last round back: where a target was mapped again, follow.
    label = maps[-1].withColumnRenamed("to", "label")
    for step in reversed(maps[:-1]):
        later = label.select(F.col("node").alias("__n"), "label")
        label = step.join(later, F.col("to") == F.col("__n"), "left").select("node", F.coalesce("label", "to").alias("label"))
    return written(label, "labels")


def lookup_many(edges: DataFrame, step: DataFrame, key: str, n: int) -> DataFrame:
    """``edges`` with the target of their end ``key``; a node with very many links is looked up by broadcast."""
    counts = edges.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    known = step.select(F.col("node").alias(key), "to").join(counts, key)
    return lookup(edges, known, key, "__c", max(1, n))


# -- candidates and links -----------------------------------------------------------------------------------------


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and full set (sorted 64-bit hashes) of the given classes, made from the texts of their representatives."""
    wanted = Sketch(nodes.select(F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long").alias("k")), "k")
    ids = Sketch(nodes.select(F.coalesce("rep", F.lit(-1)).alias("k")), "k")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            ok = ids.may_hold(batch.column(0).to_numpy())
            batch = batch.filter(pa.array(ok))
            sets = all_shingles(texts_of(batch), width)
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            hold = wanted.may_hold(np.array([int.from_bytes(n[:8], "big") >> 4 for n in node], np.int64)) if node else []
            got = [(n, s.tobytes()) for n, s, h in zip(node, sets, hold, strict=True) if h and len(s)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*got, strict=True)], ["node", "s"])

    out = rows.mapInArrow(run, "node binary, s binary")
    return written(out.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("s").alias("s")), "sets", "lz4")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "sa", 4 << 20):
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    hit.append(False)
                    continue
                union = np.concatenate([x, y])
                union.sort(kind="stable")
                n = len(union)
                both = int((union[1:] == union[:-1]).sum())
                hit.append(100 * both >= percent * (n - both))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def wanted(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    return written(nodes.distinct().join(classes.select("node", "rep"), "node"), "wanted")


def mixed_groups(labelled: DataFrame) -> DataFrame:
    """(top, node, label) of the classes under keys ``k`` that hold several components, from (k, node, label); ``top`` is
    a key's largest component. A class of another one is to be compared with the classes that came under that one."""
    labelled = written(labelled, "labelled")
    groups = labelled.groupBy("k", "label").agg(F.count(F.lit(1)).alias("c"))
    several = groups.groupBy("k").agg(F.count(F.lit(1)).alias("g"), F.sum("c").alias("n_rows"), F.max(F.struct("c", "label")).alias("t")).where("g > 1")
    several = several.select("k", F.col("t.label").alias("top"), "n_rows")
    mixed = lookup(labelled, several, "k", "n_rows", labelled.count()).where(F.col("top").isNotNull())
    return written(mixed.groupBy("top", "node").agg(F.first("label").alias("label")), "mixed")


def meet(groups: DataFrame, payload: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """Classes (top, node, label) compared within each top: those of other components with all.

    A top of at most BLOCK classes and BLOCK_BYTES is a row. Both sides of a larger one are packed into blocks of about
    that size, and a row is a pair of blocks; no row is a pair of classes. Blocks of a large top go to several tasks,
    TOGETHER blocks each, and its rows find their number of blocks by broadcast.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    sized = groups.join(payload.select("node", F.octet_length("x").alias("bytes")), "node")
    is_other = F.col("label") != F.col("top")
    n = sized.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_if(is_other).alias("n_other"), F.sum(F.when(is_other, F.col("bytes"))).alias("b_other")).where("n_other > 0")
    blocks = lambda c, b: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(b) / BLOCK_BYTES))
    n = written(n.select("top", "n", blocks("n", "b").alias("blocks"), blocks("n_other", "b_other").alias("others")), "tops")
    g = lookup(groups, n, "top", "n", groups.count()).where(F.col("blocks").isNotNull())
    g = g.join(payload, "node").select("top", "node", "label", "x", "blocks", "others")
    item = F.struct("node", "label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                top, m, p = (batch.column(c)[i].as_py() for c in range(3))
                rows = compare(top, [c for c in m if c["label"] != top] if p is None else p, m)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names)

    whole = g.where("blocks = 1").groupBy("top").agg(F.collect_list(item).alias("m"))
    whole = whole.select("top", "m", F.lit(None).cast(whole.schema["m"].dataType).alias("p")).mapInArrow(run, schema)
    if not n.where("blocks > 1").limit(1).count():
        return whole
    large = g.where("blocks > 1")
    every = large.groupBy("top", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b")).agg(F.collect_list(item).alias("m"))
    every = every.select("top", F.floor(F.col("b") / TOGETHER).alias("salt"), "m")
    other = large.where(is_other).groupBy("top", "blocks", F.pmod(F.xxhash64("node"), F.col("others")).alias("b")).agg(F.collect_list(item).alias("p"))
    other = other.select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / TOGETHER))).alias("salt"), "p")
    return whole.unionByName(other.join(every, ["top", "salt"]).select("top", "m", "p").mapInArrow(run, schema))


class Rarity:
    """Counts of shingles over some sets, by RARITY_BITS bits of their hash, as a table in the shared folder that tasks load
    by themselves. Any counts give a valid order; where shingles share a count, the order is only less apt."""

    def __init__(self, sets: DataFrame):
        self.path = scratch(sets.sparkSession, "rarity")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(1 << RARITY_BITS, np.int64)
            for batch in small_batches(batches, "s"):
                held += np.bincount(self.places(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), minlength=len(held))
            at = np.flatnonzero(held)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["p", "c"])

        out = sets.select("s").mapInArrow(count, "p long, c long").groupBy("p").agg(F.sum("c").alias("c"))
        save(out, self.path)

    @staticmethod
    def places(s: np.ndarray) -> np.ndarray:
        return (s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)

    def of(self, s: np.ndarray) -> np.ndarray:
        return _counts(self.path)[self.places(s)]


@lru_cache(maxsize=2)
def _counts(path: str) -> np.ndarray:
    held = np.zeros(1 << RARITY_BITS, np.int64)
    for got in parquet_files(path):
        held[got["p"].to_numpy()] = got["c"].to_numpy()
    return held


def prefix_length(n: int, percent: int) -> int:
    """Rarest shingles of a set of n of which one must be in any set that is similar enough."""
    return n - -(-n * percent // 100) + 1


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, node): the rarest shingles of each set, as many as the similarity makes necessary."""
    rarity = Rarity(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "s", 4 << 20):
            keys, n = [], []
            for s in batch.column(1).to_pylist():
                s = np.frombuffer(s, np.uint64)
                k = prefix_length(len(s), percent)
                keys.append(s[np.lexsort((s, rarity.of(s)))[:k]])
                n.append(k)
            if n:
                owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), owner], ["shingle", "node"])

    return sets.select("node", "s").mapInArrow(run, "shingle long, node binary")


def _within_distance(top: bytes, p: list[dict], m: list[dict]) -> list[tuple]:
    """Classes of the two blocks that have one of another component within the signature distance."""
    x, y = (np.frombuffer(b"".join(c["x"] for c in side), "<u2").reshape(-1, COMPONENTS) for side in (p, m))
    lx, ly = (np.array([c["label"] for c in side], object) for side in (p, m))
    hit_p, hit_m = np.zeros(len(p), bool), np.zeros(len(m), bool)
    for i in range(len(p)):
        ok = ((y != x[i]).sum(axis=1) <= DISTANCE) & (ly != lx[i])
        hit_p[i] = ok.any()
        hit_m |= ok
    return [(top, c["node"], c["label"]) for side, hit in ((p, hit_p), (m, hit_m)) for c, h in zip(side, hit.tolist(), strict=True) if h]


def _similar(percent: int) -> Callable:
    def compare(top: bytes, p: list[dict], m: list[dict]) -> list[tuple]:
        """Confirmed links between the blocks, as few as join the same components: a link between components that
        links found before in these blocks have joined adds nothing."""
        sets = [np.frombuffer(c["x"], np.uint64) for c in m]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(m)), size)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        up: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        for c in p:
            s = np.frombuffer(c["x"], np.uint64)
            a, b = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = b - a
            places = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            both = np.bincount(owner[places], minlength=len(m))
            for j in np.flatnonzero(100 * both >= percent * (len(s) + size - both)).tolist():
                x, y = find(c["label"]), find(m[j]["label"])
                if x != y:
                    up[x] = y
                    out.append((c["node"], m[j]["node"]))
        return out

    return compare


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs within the signature distance, and of sizes that can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, COMPONENTS) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= DISTANCE))

    x = classes.select(F.col("node").alias("a"), F.col("sig").alias("sx"), F.col("n").alias("nx"))
    y = classes.select(F.col("node").alias("b"), F.col("sig").alias("sy"), F.col("n").alias("ny"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return both.select("a", "b", "sx", "sy").mapInArrow(run, "a binary, b binary")


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, h (digest of the text), n_shingles, node (its class, null without a set), label (the
    class that names its component) and component_id."""
    spark = attach(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("h"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            sets = all_shingles(texts_of(batch), width)
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "h", "n", "node", "sig"])

    signed = written(rows.mapInArrow(sign, "doc_id long, h binary, n long, node binary, sig binary"), "signed")
    of_class = signed.where(F.col("node").isNotNull()).groupBy("node")
    classes = written(of_class.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")

    def emit(only: Sketch | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 2000):
                    batch = whole.slice(i, 2000)
                    sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, COMPONENTS)
                    keys = chunk_keys(sig).ravel()
                    owner = np.repeat(np.arange(batch.num_rows), COMPONENTS)
                    if only is not None:
                        ok = only.may_hold(keys)
                        keys, owner = keys[ok], owner[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(owner))], ["key", "node"])

        return run

    slim = classes.select("node", "sig")
    # Two hashes of the class tell whether a key has several; the pivot is found among those alone.
    probe = slim.mapInArrow(emit(None), "key long, node binary").select("key", F.xxhash64("node").alias("h"))
    shared = written(probe.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("key"), "keys")
    members = written(slim.mapInArrow(emit(Sketch(shared, "key")), "key long, node binary"), "members")
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other"), F.count(F.lit(1)).alias("n_rows")).where("pivot <> other").drop("other")
    pivots = pivots.select(F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("k"), "pivot", "n_rows")
    total = members.count()
    met = lookup(members.select(F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("k"), "node"), pivots, "k", "n_rows", total).where(F.col("pivot").isNotNull())
    members = written(met.select("k", "node", "pivot"), "members")

    # Stars: each class and the smallest class of all its keys.
    first = members.groupBy(F.col("node").alias("a")).agg(F.min("pivot").alias("b")).where("a <> b")
    candidates = written(near(first, classes, percent), "near")
    members = members.select("k", "node")
    sets = sets_of(docs, wanted(candidates.select(F.explode(F.array("a", "b")).alias("node")), classes), width)
    with batch_rows(spark, 400):
        links = written(confirmed(candidates, sets, percent), "confirmed")
    labels = components(links)

    # Keys that hold classes of several components.
    crowded = mixed_groups(members.join(labels, "node", "left").select("k", "node", F.coalesce("label", "node").alias("label")))
    sets = sets_of(docs, wanted(crowded.select("node"), classes), width)
    by_shingle = crowded.join(rare_prefixes(sets, percent), "node").select(F.unhex(F.lpad(F.hex(F.xxhash64("top", "shingle")), 16, "0")).alias("k"), "node", "label")
    mixed = mixed_groups(by_shingle)
    with batch_rows(spark, 64):
        close = written(meet(mixed, classes.select("node", F.col("sig").alias("x")), _within_distance, "top binary, node binary, label binary").distinct(), "close")
    more = meet(close, sets.select("node", F.col("s").alias("x")), _similar(percent), "a binary, b binary")
    with batch_rows(spark, 4):
        links = written(links.unionByName(more), "confirmed")
    labels = components(links)

    # Smallest id of each component, and back to the rows.
    named = classes.select("node", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = named.join(labels.select(F.col("label").alias("__l")).distinct(), F.col("label") == F.col("__l"), "left_semi")
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = joined.join(least, "label").select("node", "label", "component_id", "copies")
    alone = named.join(joined.select("node"), "node", "left_anti").select("node", "label", F.col("rep").alias("component_id"), "copies")
    known = written(ids.unionByName(alone), "components")
    return lookup(signed.select("doc_id", "h", F.col("n").alias("n_shingles"), "node"), known, "node", "copies", signed.count())


def classify(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    out = linked(docs, width, percent)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (null after all others), among those the
    one with the smallest digest of its text. Rows equal in both are one document, of which one row stays (the smallest
    by its columns). Rows without a set all stay. Ids need not differ: rows are told apart by id and text."""
    out = written(linked(docs, width, percent).where(F.col("node").isNotNull()).select("doc_id", "h", "label"), "linked")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    best = out.groupBy("label").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = lookup(out, written(best, "best"), "label", "n", out.count())
    gone = judged.where(F.col("best").isNotNull() & ~place.eqNullSafe(F.col("best"))).select("doc_id", "h").distinct()
    again = out.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def marked(ids: DataFrame) -> DataFrame:
        return written(ids.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")), "marked")

    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("doc_id").cast("long").alias("__id"), F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("__digest"))
    same = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__digest") == F.col("__h"))
    rest = rows.join(marked(gone), same, "left_anti")
    twice = marked(again)
    if twice.limit(1).count():
        one = rest.join(twice, same, "left_semi").groupBy("__id", "__digest").agg(F.min(F.struct(*names)).alias("r")).select("r.*")
        rest = rest.join(twice, same, "left_anti").select(*names).unionByName(one)
    return rest.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
