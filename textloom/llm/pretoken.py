"""Exact encoding of distinct pieces: texts are cut where no merge can reach across, each distinct piece is encoded once.

Byte-level BPE never merges across the matches of its split pattern. Where white space stands alone between two other
characters a match begins there: a space goes with what follows it, a newline is a match of its own. And a match ends
between letters and ASCII punctuation. So a text is cut before each such space and newline, and words of letters are
cut from the punctuation after them; all pieces encode to the same ids alone as in the text. Texts with adjacent white
space, or with white space at an end, are encoded as a whole.

Cutting, numbering and putting together are done on Arrow and NumPy arrays; what is encoded is each distinct word of a
batch that the batches before had not.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of a generation of cached pieces (estimated, with overheads). Two generations are kept: when the younger is
#: full it becomes the older one, and what is asked for again moves to the new younger one.
CACHE_BYTES = 24 << 20
KNOWN_WORDS = 700_000
#: White space (fixed values: Unicode's White_Space), and where it is adjacent or at an end, or there is no text.
SPACE = "[\t\n\x0b\x0c\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_CUTTABLE = f"{SPACE}{SPACE}|^{SPACE}|{SPACE}$|^$"
#: A word of letters, and the ASCII punctuation after it.
WORD_AND_SIGNS = r"^(?P<word>\pL+)(?P<signs>[!-/:-@\[-`{-~]*)$"


class Units:
    """Id sequences laid end to end: ``flat`` ids, ``size`` of each sequence."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size

    @classmethod
    def of(cls, values: list[bytes]) -> Units:
        return cls(np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4)

    @classmethod
    def joined(cls, parts: list[Units]) -> Units:
        return cls(np.concatenate([p.flat for p in parts]), np.concatenate([p.size for p in parts]))

    def take(self, at: np.ndarray) -> Units:
        """The sequences numbered ``at``, in that order."""
        n = self.size[at]
        ends = np.cumsum(n)
        # Token k of a sequence lies k after its first token.
        places = np.repeat((np.cumsum(self.size) - self.size)[at] - (ends - n), n)
        places += np.arange(len(places))
        return Units(self.flat[places], n)


class Generations:
    """A cache of bounded size that keeps what is used. ``learn(keys)`` makes the values of unknown keys."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int = CACHE_BYTES):
        self.learn, self.limit = learn, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def values(self, keys: list[str]) -> list[bytes]:
        """The values of distinct keys."""
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        need = [k for k in keys if k not in young]
        if need:
            got = {k: old[k] for k in need if k in old}
            new = [k for k in need if k not in got] if got else need
            if new:
                got.update(zip(new, self.learn(new), strict=True))
            young.update(got)
            self.held += sum(map(len, got)) + sum(map(len, got.values())) + 190 * len(got)
        return list(map(young.__getitem__, keys))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``words`` encodes distinct words of letters, each after a space; ``chunks`` other distinct chunks (those after a
    space are given without it, those after a newline with it); ``whole`` texts as they are.
    """

    def __init__(self, words: Callable[[list[str]], Units], chunks: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]]):
        self.words, self.whole = words, whole
        self.others, self.signs = Generations(chunks), Generations(whole, CACHE_BYTES // 8)
        self.newline = len(whole(["\n"])[0]) // 4
        # Words of the last batches with their ids, KNOWN_WORDS at most (then those of the last batch alone).
        self.known, self.known_units = pa.array([], pa.string()), Units.of([])

    def _words(self, words: pa.DictionaryArray) -> Units:
        distinct = words.dictionary
        found = pc.index_in(distinct, self.known).to_numpy(zero_copy_only=False)
        hit = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), bool)
        fresh = self.words(distinct.filter(pa.array(~hit)).to_pylist())
        at = np.empty(len(distinct), np.int64)
        at[hit] = found[hit].astype(np.int64)
        at[~hit] = len(self.known) + np.arange(len(fresh.size))
        every = Units.joined([self.known_units, fresh])
        units = every.take(at)
        if len(self.known) + len(fresh.size) > KNOWN_WORDS:
            self.known, self.known_units = distinct, units
        else:
            self.known, self.known_units = pa.concat_arrays([self.known, distinct.filter(pa.array(~hit))]), every
        return units

    def texts(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, NOT_CUTTABLE)
        rest = iter(self.whole(texts.filter(odd).to_pylist()))
        even = iter(self._cut(texts.filter(pc.invert(odd))))
        return [next(rest) if o else next(even) for o in odd.to_pylist()]

    def _cut(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        marked = pc.binary_join_element_wise(pa.scalar("\n"), pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, WORD_AND_SIGNS)
        ok = parts.is_valid()
        is_word = ok.to_numpy(zero_copy_only=False)
        own = parts.filter(ok)
        words, signs = own.field("word").dictionary_encode(), own.field("signs").dictionary_encode()
        units = [self._words(words), Units.of(self.signs.values(signs.dictionary.to_pylist())), Units.of(self.others.values(coded.dictionary.filter(pc.invert(ok)).to_pylist())), Units.of([b""])]
        first = np.cumsum([0] + [len(u.size) for u in units])
        # Each distinct chunk is two sequences: a word and its signs, or another chunk and nothing.
        pair = np.empty((len(is_word), 2), np.int64)
        pair[is_word, 0] = words.indices.to_numpy()
        pair[is_word, 1] = first[1] + signs.indices.to_numpy()
        pair[~is_word, 0] = first[2] + np.arange(first[3] - first[2])
        pair[~is_word, 1] = first[3]
        both = Units.joined(units).take(pair.ravel())
        chunks = Units(both.flat, both.size.reshape(-1, 2).sum(axis=1))
        out = chunks.take(coded.indices.to_numpy())
        offsets = lists.offsets.to_numpy().astype(np.int64)
        limits = np.concatenate([[0], np.cumsum(out.size)])[offsets - offsets[0]].tolist()
        return [out.flat[a + self.newline : b].tobytes() for a, b in zip(limits, limits[1:], strict=False)]


class PatternEncoder(Encoder):
    """An encoder by the matches of a split pattern; ``encode`` gives the id bytes of distinct matches."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]]):
        self.split = regex.compile(pattern).findall
        self.encode = encode
        chunks = lambda new: self._joined([self.split(c if c[0] == "\n" else " " + c) for c in new])
        super().__init__(lambda new: Units.of(encode([" " + w for w in new])), chunks, lambda new: self._joined([self.split(t) for t in new]))

    def _joined(self, parts: list[list[str]]) -> list[bytes]:
        keys = list(set().union(*parts))
        of = dict(zip(keys, self.encode(keys), strict=True)).__getitem__
        return [b"".join(map(of, p)) for p in parts]


def byte_characters() -> str:
    """The character of each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: token bytes to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def as_bytes(ids: list[list[int]], less: int = 0) -> list[bytes]:
    """Each list of ids as little-endian unsigned 32-bit integers, ``less`` taken off."""
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int64, count=sum(map(len, ids)))
    raw = (flat - less).astype("<u4").tobytes()
    out, at = [], 0
    for x in ids:
        out.append(raw[at : at + 4 * len(x)])
        at += 4 * len(x)
    return out
