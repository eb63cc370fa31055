"""Language identification by a linear-chain conditional random field (operator 2).

Words of a line form a chain. Each word emits affix, character n-gram, shape and lexicon features, neighbouring labels
interact through a learned transition matrix, and forward-backward gives each word's label marginals, so that a
code-switched line may change its language. A text's language is the label with the largest mean marginal over its words.

Learning: ``sample`` labelled texts per language with the smallest hash of id and text (a bounded sample), whole lines
of them as chains; a share of the chains is spliced from lines of two languages, so that transitions see switches. The
likelihood's gradient comes from forward-backward as well; steps are by Adam.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without a language teach nothing;
repeated rows get a row each; an empty table gives no rows; without any labelled row every text is ``und``. Ties go to
the label that sorts first. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, crc32_of_id, small_batches

UNDETERMINED = "und"
#: Texts per language, characters of them, and languages (those with the most labelled rows) that are learned from.
SAMPLE = 150
SAMPLE_CHARS = 2_000_000
LABELS = 128
BITS = 17
STEPS = 60
RATE, DECAY = 0.2, 1e-3
SPLICED = 0.3
LEXICON = 400
MEMO_WORDS, MEMO_CHARS = 250_000, 16_000_000
WORD = re.compile(r"[^\W\d_]+")


def chains(text: str) -> list[list[str]]:
    """Words of each line that has some."""
    return [w for line in text.lower().split("\n") if (w := WORD.findall(line))]


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def all_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, and how many it has: prefixes, suffixes (of one to four letters), inner n-grams (two
    and three characters, the word's ends among them), length class and the word itself, over all its letters; all words
    at once, each feature of a word once."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    row = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)  # a character's place, and how many follow with it
    left = np.repeat(n, n) - begin
    owner, names = [np.arange(len(n))] * 2, [np.fromiter(map(xxhash.xxh3_64_intdigest, marked), np.uint64, len(n)), np.minimum(n, 14).astype(np.uint64) * M3]
    gram = codes.copy()
    for k in (2, 3, 4, 5):
        gram = gram[:-1] * M1 + codes[k - 1 :] * M2
        gram ^= gram >> np.uint64(31)
        at, rest = begin[: len(gram)], left[: len(gram)]
        whole = rest >= k
        for salt, pick in (("g", whole if k < 4 else None), ("p", whole & (at == 0)), ("s", rest == k)):
            if pick is not None:
                hit = np.flatnonzero(pick)
                owner.append(row[hit])
                names.append((gram[hit] + np.uint64(ord(salt) * 8 + k)) * M3)
    x = np.concatenate(names)
    x = ((x ^ (x >> np.uint64(29))) * M2) >> np.uint64(64 - BITS)
    pairs = np.sort((np.concatenate(owner) << BITS) | x.astype(np.int64))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return pairs & ((1 << BITS) - 1), np.bincount(pairs >> BITS, minlength=len(n))


def features(word: str) -> list[int]:
    return all_features([word])[0].tolist()


class Crf:
    """Labels, emission weights by hashed feature (and lexicon weights), transitions and start weights."""

    def __init__(self, labels: list[str], emit: np.ndarray, move: np.ndarray, start: np.ndarray, lexicon: dict[str, np.ndarray]):
        self.labels, self.emit, self.move, self.start, self.lexicon = labels, emit, move, start, lexicon
        self.memo: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((1024, len(labels)), np.float32)

    def __getstate__(self):
        return self.labels, self.emit, self.move, self.start, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, made once per distinct word (up to MEMO_WORDS) and worker."""
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_CHARS:
            self.memo, self.held = {}, 0
        new = [w for w in set(words) if w not in self.memo]
        need = len(self.memo) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[: len(self.memo)], np.zeros((2 * need - len(self.memo), self.rows.shape[1]), np.float32)])
        if new:
            flat, n = all_features(new)
            first = len(self.memo)
            sums = np.add.reduceat(self.emit[flat], np.cumsum(n) - n, axis=0)
            for k, w in enumerate(new):
                if w in self.lexicon:
                    sums[k] += self.lexicon[w]
                self.memo[w] = first + k
                self.held += len(w)
            self.rows[first : first + len(new)] = sums
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return self.rows[at]


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of chains laid end to end in ``emit`` (words x labels).

    Chains are handled longest first and side by side, one step per position; vectors are scaled to sum 1. Returns
    marginals (words x labels) and, if asked for, the expected transitions, the starts and the log-likelihood's
    normaliser.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    n = lengths[order]
    top = emit.max(axis=1, keepdims=True)
    e = np.exp(emit - top)
    m = np.exp(move)
    steps = int(n[0])
    # alive[t]: chains that are longer than t, which are the first ones.
    alive = np.searchsorted(-n, -np.arange(steps), side="left")
    alpha = np.empty_like(e)
    log_z = float(top.sum())
    a = e[first] * np.exp(start)
    for t in range(steps):
        k = alive[t]
        at = first[:k] + t
        if t:
            a = (a[:k] @ m) * e[at]
        z = a.sum(axis=1, keepdims=True)
        if pairs:
            log_z += float(np.log(z).sum())
        a = a / z
        alpha[at] = a
    out = np.empty_like(e)
    expected = np.zeros_like(m)
    beta = np.ones((len(n), e.shape[1]), e.dtype)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        if t + 1 < steps and alive[t + 1]:
            j = alive[t + 1]
            right = e[at[:j] + 1] * beta[:j]
            left = right @ m.T
            if pairs:
                p = alpha[at[:j]]
                # joint(x, y) is p(x) m(x, y) right(y), scaled to sum 1 per chain
                expected += (p / (p * left).sum(axis=1, keepdims=True)).T @ right * m
            beta[:j] = left / left.sum(axis=1, keepdims=True)
        g = alpha[at] * beta[:k]
        out[at] = g / g.sum(axis=1, keepdims=True)
    return (out, expected, out[first].sum(axis=0), log_z) if pairs else out


def learn(texts: list[tuple[str, str]], seed: int = 3, steps: int = STEPS) -> Crf | None:
    """Fit on (language, text) pairs."""
    labels = sorted({lang for lang, _ in texts})
    if not labels:
        return None
    of = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    pool = [(of[lang], w) for lang, t in texts for w in chains(t)]
    if not pool:
        return None
    seqs: list[tuple[list[str], list[int]]] = []
    for i in rng.permutation(len(pool)):
        y, w = pool[i]
        if rng.random() < SPLICED:
            y2, w2 = pool[rng.integers(len(pool))]
            w, ys = [*w, *w2], [y] * len(w) + [y2] * len(w2)
        else:
            ys = [y] * len(w)
        seqs.append((w, ys))
    words = [x for w, _ in seqs for x in w]
    y = np.array([i for _, ys in seqs for i in ys])
    lengths = np.array([len(w) for w, _ in seqs])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([vocabulary[w] for w in words])
    k = len(labels)
    # Lexicon: words that most often stand in one language, as features of their own.
    counts: dict[int, Counter] = defaultdict(Counter)
    for w, i in zip(words, y.tolist(), strict=True):
        counts[i][w] += 1
    lexicon = {w for i in counts for w, _ in counts[i].most_common(LEXICON)}
    lex_of = {w: i for i, w in enumerate(sorted(lexicon))}
    flat, n_f = all_features(list(vocabulary))
    used, flat = np.unique(flat, return_inverse=True)
    bounds = np.cumsum(n_f) - n_f
    row = np.repeat(np.arange(len(n_f)), n_f)
    lex = np.array([lex_of.get(w, -1) for w in vocabulary])
    has = lex >= 0
    params = [np.zeros((len(used), k)), np.zeros((len(lex_of), k)), np.eye(k), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    observed = np.eye(k)[y]
    starts = np.cumsum(lengths) - lengths
    follows = np.ones(len(y), bool)
    follows[starts] = False
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (y[:-1][follows[1:]], y[1:][follows[1:]]), 1)
    seen_starts = observed[starts].sum(axis=0)
    for step in range(1, steps + 1):
        emit, lex_w, move, start = params
        scores = np.add.reduceat(emit[flat], bounds, axis=0)
        scores[has] += lex_w[lex[has]]
        marginal, moves, first, _ = forward_backward(scores[at], lengths, move, start, pairs=True)
        diff = np.stack([np.bincount(at, weights=(marginal - observed)[:, i], minlength=len(n_f)) for i in range(k)], axis=1)
        g_emit = np.stack([np.bincount(flat, weights=diff[row, i], minlength=len(used)) for i in range(k)], axis=1)
        g_lex = np.stack([np.bincount(lex[has], weights=diff[has, i], minlength=len(lex_of)) for i in range(k)], axis=1)
        grads = [g_emit, g_lex, moves - seen_moves, first - seen_starts]
        for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
            g = g / len(y) + DECAY * p / len(y) ** 0.5
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    emit = np.zeros((1 << BITS, k), np.float32)
    emit[used] = params[0]
    return Crf(labels, emit, params[2].astype(np.float32), params[3].astype(np.float32), {w: params[1][i].astype(np.float32) for w, i in lex_of.items()})


def training_texts(docs: DataFrame, learn_from, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``sample`` texts per language (those with the smallest hash of id and text), at most SAMPLE_CHARS characters
    of whole texts per language, and at most LABELS languages. Hashes are ranked first, texts are fetched for the ranked
    ones alone; rows that repeat a text under one id and language count once."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(learn_from)
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    slim = rows.select("lang", F.xxhash64(F.lit(11), "doc_id", "text").alias("h"), F.length("text").alias("n"))
    # The hashes are spread evenly: of n rows about 8 * sample lie below a bound of that share, and no task ranks more.
    langs = slim.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LABELS)
    bound = F.least(F.lit(1.0), F.lit(8.0 * sample) / F.col("rows")) * 2.0**64 - 2.0**63
    near = slim.join(F.broadcast(langs.select(F.col("lang").alias("__l"), bound.alias("__b"))), (F.col("lang") == F.col("__l")) & (F.col("h") <= F.col("__b")))
    near = near.groupBy("lang", "h").agg(F.max("n").alias("n"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)
    ranked = ranked.withColumn("chars", F.sum("n").over(Window.partitionBy("lang").orderBy("r"))).where((F.col("chars") <= SAMPLE_CHARS) | (F.col("r") == 1))
    picked = F.broadcast(ranked.select(F.col("lang").alias("__l"), F.col("h").alias("__h")))
    found = rows.join(picked, (F.xxhash64(F.lit(11), "doc_id", "text") == F.col("__h")) & (F.col("lang") == F.col("__l")))
    got = found.groupBy("lang", "__h").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], r["__h"]))]


def learned(docs: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """A model from the rows of ``docs`` whose crc32 of the id's text is not 2 modulo 4."""
    return learn(training_texts(docs, crc32_of_id() % 4 != 2, sample))


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score and, for code-switched texts, the share of each label over the words, in label order."""
    spark = attach(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: Crf | None = shared.value
        for batch in small_batches(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            out: list[tuple] = [(UNDETERMINED, 0.0, None)] * len(texts)
            if crf is not None:
                words, lengths, owner = [], [], []
                for i, t in enumerate(texts):
                    found = chains(t) if t else []
                    if not any(c.isalpha() for line in found for w in line for c in w):
                        continue  # digits and signs that look like word characters, but no letter
                    for c in found:
                        words += c
                        lengths.append(len(c))
                        owner.append(i)
                if words:
                    n = np.array(lengths)
                    marginal = forward_backward(crf.scores(words), n, crf.move, crf.start)
                    doc = np.repeat(np.array(owner), n)
                    total = np.bincount(doc, minlength=len(texts))
                    share = np.stack([np.bincount(doc, weights=marginal[:, i], minlength=len(texts)) for i in range(len(crf.labels))], axis=1)
                    for i in np.flatnonzero(total):
                        p = share[i] / total[i]
                        best = int(p.argmax())
                        out[i] = (crf.labels[best], min(1.0, float(p[best])), p.round(6).tolist())
            lang, score, parts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "label_shares"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, label_shares array<double>")
