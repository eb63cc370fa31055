"""Byte-level BPE by sentencepiece (operator 8).

A sentencepiece BPE model is serialised straight from a rank file: one piece per token, its bytes mapped to printable
characters, scored by the negative rank; the normaliser is the identity, no mark is put before a text and white space
is left alone. Matches of the split pattern are mapped and encoded by that model; ids are the ranks. Decoding maps each
piece's characters back to bytes.

Defined results: a null text is the empty text, with no ids and no bytes; ties can't arise, for ranks are distinct;
repeated rows get a row each; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, holds, small_batches
from .pretoken import PatternEncoder, as_bytes, byte_characters, load_ranks


CHARACTERS = byte_characters()
TO_CHARACTER = dict(enumerate(CHARACTERS))


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_CHARACTER)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, a non-negative integer or a float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank vocabulary; piece 0 is the unknown piece, piece rank + 1 the token."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs a rank")
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    out += [_field(1, _field(1, mapped(t).encode()) + _field(2, -float(r)) + _field(3, 1)) for t, r in by_rank]
    # Trainer: model type BPE, vocabulary size, no begin, end or padding pieces.
    trainer = _field(3, 2) + _field(4, len(out)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.cache = PatternEncoder(pattern, self._pieces)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out = as_bytes(self.model.encode([mapped(r) for r in raw], num_threads=1), 1)
        # A piece that is a token as a whole is that token, whether or not its merges lead there.
        return [struct.pack("<I", self.ranks[r]) if len(o) > 4 and r in self.ranks else o for r, o in zip(raw, out, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        return self.cache.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``docs`` (text among them) with ids (binary, little-endian unsigned 32-bit), n_tokens and the
    decoded bytes; columns of these names in ``docs`` are replaced."""
    attach(docs.sparkSession)
    own = {"ids", "n_tokens", "decoded"}
    kept = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("byte_bpe", codec.cache_clear)
        bpe = codec(path, pattern)
        for batch in small_batches(batches, "text", 4 << 20):
            ids = bpe.encode(batch.column(batch.schema.get_field_index("text")))
            decoded = pa.array([bpe.decode(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), decoded], [*batch.schema.names, "ids", "n_tokens", "decoded"])

    own_fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *own_fields]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, sha256 of its ids and of the decoded bytes."""
    attach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("byte_bpe", codec.cache_clear)
        bpe, sha = codec(path, pattern), lambda b: hashlib.sha256(b).hexdigest()
        for batch in small_batches(batches, "text", 4 << 20):
            ids = bpe.encode(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i) for i in ids]), pa.array([sha(bpe.decode(i)) for i in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
