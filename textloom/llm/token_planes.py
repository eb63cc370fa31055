"""Token ids in bit- or byte-plane files (operator 1).

A file holds blocks of a fixed number of ids. Each block is transposed into planes (byte planes: all first
bytes, all second bytes, ...; bit planes: all bits 0, all bits 1, ...) and each plane is compressed with
zstandard by itself, so that the empty high planes cost a few bytes. A footer holds the chunk index (where each
block's planes lie) and the document index; readers seek by it.

    file   := MAGIC block* footer footer-length(u64) MAGIC
    footer := zstd(JSON {"plane", "block", "chunks": [[offset, n_ids, [plane lengths]]], "n_ids", "n_docs"})
              with the documents as arrays: ids, null flags, token counts

Documents lie in ascending order of doc_id over all files (nulls first, equal ids by a hash of their text).
Defined results: a null text is the empty text and has the end id alone; an empty table gives no file and no
rows; repeated ids and repeated rows are kept, each with a row of its own; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, open_input, open_output, scratch, small_batches, written
from .pretoken import Encoder, Units, as_bytes, byte_characters

MAGIC = b"TLPLANE1"
BLOCK = 1 << 16
#: Chunks that are encoded in one call.
JOINED = 4000


# -- the file format -------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Planes of a block: 4 byte planes, or 32 bit planes of packed bits (low bit first)."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)[:n]


class PlaneWriter:
    """Writes one file; memory holds one block and the two indexes."""

    def __init__(self, uri: str, plane: str = "byte", block: int = BLOCK, level: int = 3):
        self.uri, self.plane, self.block = uri, plane, block
        self.out, self.zip = open_output(uri), zstandard.ZstdCompressor(level=level)
        self.at = self.out.write(MAGIC)
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0
        self.chunks: list[list] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, end, self.block):
            part = ids[i : min(i + self.block, end)]
            zipped = [self.zip.compress(p) for p in to_planes(part, self.plane)]
            self.chunks.append([self.at, len(part), [len(z) for z in zipped]])
            for z in zipped:
                self.at += self.out.write(z)
            self.n_ids += len(part)
        self.held, self.n_held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> dict:
        if self.n_held:
            self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        head = json.dumps({"plane": self.plane, "block": self.block, "chunks": self.chunks, "n_ids": self.n_ids, "n_docs": len(self.docs)}).encode()
        footer = self.zip.compress(struct.pack("<Q", len(head)) + head + ids.tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes())
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return {"path": self.uri, "n_docs": len(self.docs), "n_ids": self.n_ids, "n_blocks": len(self.chunks)}


def read_file(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in this file, its ids) of each document; one block and one document in memory."""
    with open_input(uri) as f:
        size = f.size()
        f.seek(size - 16)
        tail = f.read(16)
        f.seek(0)
        if tail[8:] != MAGIC or f.read(8) != MAGIC:
            raise ValueError(f"not a plane file: {uri}")
        n_footer = struct.unpack("<Q", tail[:8])[0]
        f.seek(size - 16 - n_footer)
        raw = zstandard.ZstdDecompressor().decompress(f.read(n_footer))
        n_head = struct.unpack_from("<Q", raw)[0]
        head = json.loads(raw[8 : 8 + n_head])
        n, at = head["n_docs"], 8 + n_head
        ids = np.frombuffer(raw, "<i8", n, at)
        null = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        counts = np.frombuffer(raw, "<u8", n, at + 9 * n)
        unzip = zstandard.ZstdDecompressor()
        held, chunks, before = np.empty(0, "<u4"), iter(head["chunks"]), 0
        for doc, absent, count in zip(ids.tolist(), null.tolist(), counts.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < count:
                offset, n_ids, lengths = next(chunks)
                f.seek(offset)
                planes = [unzip.decompress(f.read(x)) for x in lengths]
                parts.append(from_planes(planes, n_ids, head["plane"]))
                have += n_ids
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (None if absent else doc), before, held[:count]
            held = held[count:]
            before += count


# -- encoding ---------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """Texts to id bytes as the tokenizers library gives them (add_special_tokens=False).

    Its byte-level pre-tokenizer takes no context over a cut between chunks, so distinct chunks are encoded once per
    worker, many in one call: joined again they split at the same places, and the bytes of each token tell where a
    chunk's ids end. A text with the string of an added token goes to the library as it is.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [a["content"] for a in spec.get("added_tokens") or ()]
    pre = spec.get("pre_tokenizer") or {}
    whole = lambda texts: as_bytes([e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
    plain = lambda texts: whole(pc.fill_null(texts, "").to_pylist())
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("model", {}).get("type") != "BPE":
        return plain
    vocabulary = tok.get_vocab(with_added_tokens=False)
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for piece, i in vocabulary.items():
        n_bytes[i] = len(piece)  # a character of a byte-level piece is a byte

    # Words of letters need no split: the model alone, on their bytes' characters.
    bare = Tokenizer(tok.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    characters = {**dict(enumerate(byte_characters())), 32: " " + byte_characters()[32]}

    def parted(joined: str, ids: list[int]) -> Units:
        """Ids of chunks by where their bytes end: white space is at the beginning of chunks alone."""
        flat = np.array(ids, "<u4")
        raw = np.frombuffer(joined.encode(), np.uint8)
        limits = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))[1:]
        stops = np.searchsorted(np.cumsum(n_bytes[flat]), limits) + 1
        return Units(flat, np.diff(stops, prepend=0))

    def chunks(new: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(new), JOINED):
            joined = (" " + " ".join(new[i : i + JOINED])).replace(" \n", "\n")
            got = parted(joined, tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
            data, stops = got.flat.tobytes(), (np.cumsum(got.size) * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def words(new: list[str]) -> Units:
        out = [Units.of([])]
        for i in range(0, len(new), JOINED):
            joined = " " + " ".join(new[i : i + JOINED])
            out.append(parted(joined, bare.encode_batch_fast([joined.encode().decode("latin-1").translate(characters)], add_special_tokens=False)[0].ids))
        return Units.joined(out)

    cache = Encoder(words, chunks, whole)

    def encode(texts: pa.Array) -> list[bytes]:
        special = np.zeros(len(texts), bool)
        for a in added:
            special |= pc.match_substring(pc.fill_null(texts, ""), a).to_numpy(zero_copy_only=False)
        if not special.any():
            return cache.texts(texts)
        out = cache.texts(pc.if_else(pa.array(special), "", texts))
        where = np.flatnonzero(special)
        for i, got in zip(where, whole(texts.take(pa.array(where)).to_pylist()), strict=True):
            out[i] = got
        return out

    return encode


INDEX = "part int, path string, n_docs long, n_ids long, n_blocks long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, plane: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write plane files to the shared folder in ascending doc_id order.

    Returns the index of files, itself a written table. A task that runs again writes a file of its own; only files
    that the index names count.
    """
    spark = attach(docs.sparkSession)
    folder = scratch(spark, "planes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = library_encoder(tokenizer), None
        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        for batch in small_batches(batches, "text", 12 << 20):
            if out is None:
                out = PlaneWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}.tlp", plane, block)
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                out.add(doc, ids + end)
        if out is not None:
            row = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{k: pa.array([row[k]]) for k in ("path", "n_docs", "n_ids", "n_blocks")}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(write, INDEX), "planes-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # One row per file: the running sum over files is small however large the corpus is.
    base = index.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("path", F.coalesce("base", F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for doc, before, ids in read_file(path):
                    rows.append((doc, first + before, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    spread = base.repartition(max(1, min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096)), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
