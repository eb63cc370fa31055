"""Operators 2 and 7: models against brute force and on what they should learn."""

import itertools
import random

import numpy as np
import pytest

from textloom.llm import language, queries, toxicity


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([3, 1, 4])
    emit, move, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, moves, _, log_z = language.forward_backward(emit, lengths, move, start, pairs=True)
    first, want, pairs, z_sum = 0, np.zeros((8, 3)), np.zeros((3, 3)), 0.0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=n))
        scores = np.array([start[p[0]] + sum(emit[first + t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        z = np.logaddexp.reduce(scores)
        z_sum += z
        for p, w in zip(paths, np.exp(scores - z), strict=True):
            for t, y in enumerate(p):
                want[first + t, y] += w
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w
        first += n
    # Starts enter the marginals through the first word.
    assert np.allclose(got, want, atol=1e-6) and np.allclose(moves, pairs, atol=1e-6) and abs(log_z - z_sum) < 1e-5


SYLLABLES = {"aa": "ka lo mi tu".split(), "bb": "schra pfen zug gen".split()}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def text(rng, lang, n=40):
    return "\n".join(" ".join(word(rng, lang) for _ in range(8)) for _ in range(n // 8))


def test_language_and_code_switching(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang), lang) for i in range(80) for lang in [["aa", "bb"][i % 2]]]
    rows += [(500, None, "aa"), (501, "12 !? ²", "bb"), (502, "", None), (503, " ".join([word(rng, "aa") for _ in range(30)] + [word(rng, "bb") for _ in range(12)]), None), (504, text(rng, "bb"), None), (504, text(rng, "bb"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(df)
    got = language.identify(df.select("doc_id", "text"), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[:80])
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[500]["score"] == 0
    assert by[503]["lang_pred"] == "aa" and 0.2 < by[503]["label_shares"][1] < 0.4
    assert all(0 <= r["score"] <= 1 for r in got)
    # Transitions are learned: staying is likelier than switching.
    assert model.move[0, 0] > model.move[0, 1] and model.move[1, 1] > model.move[1, 0]


def test_language_without_labels(spark, docs, no_docs):
    none = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert language.learned(none) is None
    assert {r["lang_pred"] for r in language.identify(none, None).collect()} == {"und"}
    assert language.identify(no_docs, language.learned(no_docs)).count() == 0


def test_language_awkward_rows(docs, rows):
    got = language.identify(docs, language.learned(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[110] == by[111] == by[112] == by[114] == "und" and by[115] in ("a", "b")


def test_op2_query_ignores_labels_when_predicting(spark, patch_tables):
    rng = random.Random(4)
    rows = [(i, text(rng, ["aa", "bb"][i % 2]), ["aa", "bb"][i % 2]) for i in range(60)]
    import zlib

    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, t, "bb" if lang == "aa" else "aa") if i in held else (i, t, lang) for i, t, lang in rows]
    a, b = (sorted(tuple(r) for r in queries.op2_language_crf(spark, patch_tables(documents=spark.createDataFrame(x, "doc_id long, text string, lang string"))).collect()) for x in (rows, wrong))
    assert a == b and {r[0] for r in a if r[1]} == held


def test_ftrl_equals_a_plain_version():
    rng = random.Random(1)
    fast = toxicity.Ftrl(6, alpha=0.5, beta=1.0, l1=0.3, l2=0.2)
    z, n = [0.0] * 7, [0.0] * 7
    for _ in range(200):
        x = sorted(rng.sample(range(6), 3)) + [6]
        y = int(1 in x)
        fast.learn(np.array(x), y)
        w = {}
        for i in x:
            l1 = 0.0 if i == 6 else 0.3
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1 + n[i] ** 0.5) / 0.5 + 0.2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in x:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i] += g - s * w[i]
            n[i] += g * g
    assert np.allclose(fast.z, z) and np.allclose(fast.n, n)


def toxic_rows(n=400):
    rng = random.Random(8)
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vile", "scum", "moron"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity(spark, patch_tables):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "vile scum moron, vile scum moron"), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None), (1, 0)], "doc_id long, toxic int")
    got = queries.op7_toxicity(spark, patch_tables(documents=docs, labels=labels)).collect()
    assert len(got) == len(rows) + 4
    by = {r["doc_id"]: r for r in got}
    held = [(by[i]["predicted"], y) for i, _, y in rows if by[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert by[902]["predicted"] == 1 and by[900]["predicted"] == 0 and by[900]["score"] == by[901]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_weights_are_few(spark):
    rows = toxic_rows()
    examples = [(y, np.unique(toxicity.feature_ids(t))) for _, t, y in rows]
    assert 1 < len(toxicity.fit(examples)) < 2000


def test_toxicity_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.model_of(docs, none) == {}
    assert {r["score"] for r in toxicity.score(docs, {}, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(no_docs, {}, ["doc_id"]).count() == 0


@pytest.mark.parametrize("t", ["", "one", "one two", "a b c d"])
def test_feature_counts(t):
    n = len(t.split())
    assert len(toxicity.feature_ids(t)) == n + max(0, n - 1) + max(0, n - 2)
