"""Operators 6, 9 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import decontaminate, line_dedup, near_dup, queries

from conftest_texts import body, sentence

# -- 6 --------------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def contamination(text, items, width=13):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(lower(t or ""))
        for i in range(max(1, len(v) - width + 1)) if v else ():
            win = v[i : i + width]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aZ09 é-\x00\x7f{[/:@`\n", max_size=30))
def test_words(text):
    assert [w.decode() for w in decontaminate.words(text)] == WORD.findall(lower(text))


def items_and_docs(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.choice([3, 8, 13, 20, 30]), 40)) for i in range(25)] + [(25, None), (26, ""), (27, "?!"), (27, "a second text of item"), (9, sentence(rng, 20, 40)), (30, "common common common")]
    docs = []
    for i in range(60):
        t = sentence(rng, rng.choice([5, 40, 200]), 60)
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split(" ")
            at = rng.randint(0, max(0, len(v) - 5))
            t += " " + " ".join(v[at : at + rng.choice([6, 13, 16, 99])]).upper()
        docs.append((i, t + sentence(rng, 3)))
    docs += [(100, None), (101, ""), (102, items[0][1] * 1), (102, items[0][1]), (103, "common " * 3000)]
    return items, docs


@pytest.mark.parametrize("seed, limit", [(1, 10**9), (2, 60), (3, 7)])
def test_op6(spark, monkeypatch, seed, limit):
    """One block of items, and many."""
    items, docs = items_and_docs(seed)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", limit)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, n_words int")
    got = decontaminate.contamination(df, bench).collect()
    want = sorted((d, *contamination(t, items)) for d, t in docs)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_op6_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] or r["n_hit"] for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_op6_query_digests(spark, patch_tables):
    items, docs = items_and_docs(3)
    folder = patch_tables(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = queries.op6_decontamination(spark, folder).collect()
    want = []
    for d, t in docs:
        n, h, found, bad = contamination(t, items)
        want.append((d, n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bad))
    assert sorted(map(tuple, got)) == sorted(want)


# -- 9 --------------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def drop_lines(rows, least=line_dedup.MIN_CHARS):
    """rows of (doc_id, text hash, text): per row the numbers of the lines that go."""
    occ = sorted({(d is not None, d or 0, h, i, line_dedup.normal(x)) for d, h, t in rows for i, x in enumerate((t or "").split("\n")) if len(line_dedup.normal(x)) >= least})
    out = {}
    for k, (has, d, h, i, x) in enumerate(occ):
        if any(one_edit(x, y[4]) for y in occ[:k]):
            out.setdefault((d if has else None, h), []).append(i)
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abc", min_size=2, max_size=140), st.integers(0, 139), st.sampled_from(["sub", "del", "ins"]), st.sampled_from("abcx"))
def test_half_keys_meet_within_an_edit(x, at, kind, c):
    at = min(at, len(x) - 1)
    y = x[:at] + c + x[at + 1 :] if kind == "sub" else x[:at] + x[at + 1 :] if kind == "del" else x[:at] + c + x[at:]
    assert one_edit(x, y)
    of = lambda keys: {k: (g, j) for k, g, j in keys}
    a, b = of(line_dedup.half_keys(x)), of(line_dedup.half_keys(y))
    assert a.keys() & b.keys()
    a, b = (of(line_dedup.eighth_keys(t, [h[k] for k in a.keys() & b.keys()])) for t, h in ((x, a), (y, b)))
    assert a.keys() & b.keys()
    # A deletion in an eighth that both share makes them meet.
    if x != y:
        own, cut = zip(line_dedup.variant_hashes(x), line_dedup.variant_hashes(y), strict=True)
        span = lambda t, m: range(*line_dedup.part_span(len(t), 8, *m))
        met = [({int(cut[0][i]) for i in span(x, a[k])}, {int(cut[1][i]) for i in span(y, b[k])}) for k in a.keys() & b.keys()]
        assert any(p & q or own[0] in q or own[1] in p for p, q in met)


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_variant_hashes(n):
    x = "".join(random.Random(n).choice("abé😀") for _ in range(n))
    own, cut = line_dedup.variant_hashes(x)
    assert cut.tolist() == [line_dedup.variant_hashes(x[:i] + x[i + 1 :])[0] if n > 1 else 0 for i in range(n)]
    assert own not in cut.tolist()


def line_rows(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.choice([10, 15, 16, 17, 30, 63, 64, 65, 96, 200]))) + "end" for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + "z" + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x.upper(), " " + x])
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    hot = "the very common line of all"
    rows += [(200 + i, f"{hot}\nown line number {i} of this text") for i in range(30)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, rows[0][1]), (303, rows[0][1]), (303, rows[1][1]), (None, rows[2][1]), (304, "x" * 20_000), (305, "x" * 19_999)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op9(spark, seed):
    from pyspark.sql import functions as F

    rows = line_rows(seed)
    df = spark.createDataFrame([(d, t, "a", k, 1, 2) for k, (d, t) in enumerate(rows)], "doc_id long, text string, dropped string, n int, __id int, __h int").repartition(3)
    hashes = {r["n"]: r["h"] for r in df.select("n", F.xxhash64("text").alias("h")).collect()}
    drops = drop_lines([(d, hashes[k], t) for k, (d, t) in enumerate(rows)])
    got = {r["n"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        gone = drops.get((d, hashes[k]), [])
        assert got[k]["dropped"] == gone, (d, t)
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
        assert (got[k]["text"], got[k]["__id"], got[k]["__h"]) == (t if not gone else left, 1, 2)
    assert sum(map(len, drops.values())) > 20


SHORT = [(1, "les.\nand ornd.\n\nles."), (2, " LES.\ndes.\n\na"), (3, "a"), (4, "and ornd.\nb\n \nfifteen letters"), (5, "fifteen letters\nfifteen lettersx"), (6, "les.\na line that is long enough\na line that is long enouhg?\na line that is long enouhg")]


def test_op9_query_drops_copies_of_short_lines(spark, patch_tables):
    """Exact copies of any line that isn't blank go; short lines one edit apart stay."""
    folder = patch_tables(documents=spark.createDataFrame(SHORT, "doc_id long, text string"))
    got = {r["doc_id"]: (r["dropped_lines"], r["n_kept_or_blank"]) for r in queries.op9_line_dedup(spark, folder).collect()}
    assert got == {1: ("3", 3), 2: ("0", 3), 3: ("0", 0), 4: ("0", 3), 5: ("0", 1), 6: ("0,3", 2)}


def test_line_stage_drops_copies_of_short_lines(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in SHORT], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {1: "les.\nand ornd.\n", 2: "des.\n\na", 4: "b\n \nfifteen letters", 5: "fifteen lettersx", 6: "a line that is long enough\na line that is long enouhg?"}


def test_op9_empty_and_awkward(docs, rows, no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(rows) and set(docs.columns) <= set(out.columns)


# -- 10 -------------------------------------------------------------------------------------------------------------------


def sets(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(rows, width=2):
    """Per row a number of its component, None without a set."""
    s = [sets(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[top(i)] = top(j)
    return [top(i) if s[i] else None for i in range(len(rows))]


def components(rows, width=2):
    least, of = {}, groups(rows, width)
    for g, (d, _) in zip(of, rows, strict=True):
        if d is not None and g is not None:
            least[g] = min(least.get(g, d), d)
    return [(len(sets(t, width)), d if g is None else least.get(g)) for g, (d, t) in zip(of, rows, strict=True)]


def passage_rows():
    """Unlike texts that share a long passage, and near copies among them that one word tells apart."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(50)]
        rows.append(" ".join(own) + " " + passage)
        if i % 10 == 0:
            own[rng.randrange(50)] = "changed"
            rows.append(passage + " " + " ".join(own))
    return list(enumerate(rows))


def test_op10_shared_passage(spark):
    """Keys that a common passage gives hold many components: the links in them are found all the same."""
    rows = passage_rows()
    got = {r["doc_id"]: r["component_id"] for r in near_dup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, components(rows), strict=True)}
    assert sum(d != c for d, c in got.items()) == 15


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.randoms())
def test_prefixes_of_similar_sets_meet(n, less, more, rng):
    """Under any one order, the prefixes of two sets with the similarity share an element."""
    x = set(range(n))
    y = set(rng.sample(sorted(x), max(0, n - less))) | set(range(100, 100 + more))
    if 100 * len(x & y) >= 80 * len(x | y):
        order = list(range(120))
        rng.shuffle(order)
        a, b = (set(sorted(s, key=order.__getitem__)[: near_dup.prefix_length(len(s), 80)]) for s in (x, y))
        assert a & b


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.choice([4, 20, 60, 150]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
            rows.append(" ".join(w))
            if rng.random() < 0.5:
                base = w  # chains: each near the one before
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "two words"), (506, rows[0][1]), (506, rows[0][1]), (506, "else here at all"), (None, rows[1][1]), (None, "nobody has this"), (None, None)]


@pytest.mark.parametrize("seed, width", [(1, 2), (2, 2), (3, 5)])
def test_op10(spark, seed, width):
    rows = near_rows(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, node string, label string").repartition(3)
    got = near_dup.classify(df, width).collect()
    want = [(d, n, c, d == c) for (d, _), (n, c) in zip(rows, components(rows, width), strict=True)]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_op10_large_group(spark):
    """Many near copies of one text, and stragglers that hang on by one copy."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.classify(df).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, components(rows), strict=True)}


def test_op10_empty_and_awkward(docs, rows, no_docs):
    assert near_dup.classify(no_docs).count() == 0
    assert near_dup.classify(docs, 5).count() == len(rows)


def test_chunks_cover_the_distance():
    """Any signatures within DISTANCE share a key."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, (200, near_dup.COMPONENTS)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(near_dup.COMPONENTS, near_dup.DISTANCE, replace=False)] ^= 1
    x, y = near_dup.chunk_keys(a), near_dup.chunk_keys(b)
    assert all(set(p.tolist()) & set(q.tolist()) for p, q in zip(x, y, strict=True))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    nodes = {x for e in edges for x in e}
    names = {x: rng.randbytes(4) for x in nodes}
    df = spark.createDataFrame([(bytearray(names[a]), bytearray(names[b])) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["label"]) for r in near_dup.components(df).collect()}
    for part in ([*range(61)], [100 + i for i in range(50)]):
        least = min(names[x] for x in part)
        assert all(got[names[x]] == least for x in part)


def test_bodies_differ():
    assert body(random.Random(1)) != body(random.Random(2))
