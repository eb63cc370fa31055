import random

from textloom import grammars
from textloom.operators import parse
from textloom.semantics import chains, modules


def run_chain(block, outer):
    """Plain model: a program is a list of (key, value) or inner lists; resolves each key in order of appearance."""
    out, space = [], dict(outer)
    for s in block:
        if isinstance(s, list):
            out += run_chain(s, space)
        else:
            key, v = s
            got = v if isinstance(v, int) else space.get(v)
            space[key] = got
            out.append((key, got))
    return out


def render(block):
    return "{ " + " ".join(render(s) if isinstance(s, list) else f"{s[0]} = {s[1]};" for s in block) + " }"


def make(rng, depth=0):
    return [make(rng, depth + 1) if depth < 3 and rng.random() < 0.25 else (rng.choice("abcd"), rng.choice([1, 2, *"abcdz"])) for _ in range(rng.randint(1, 5))]


def test_chains_equal_a_plain_model(spark):
    rng = random.Random(4)
    programs = [make(rng) for _ in range(25)]
    docs = spark.createDataFrame([(i, render(p)) for i, p in enumerate(programs)], "doc_id long, text string")
    p = parse.parse(docs, grammars.chain_syntax(), ("node", "cap"))
    got = chains.resolve(parse.nodes(p), parse.captures(p)).collect()
    for i, program in enumerate(programs):
        mine = [(r["key"], int(r["value"]) if r["value"] else None) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["key_id"])]
        assert mine == run_chain(program, {}), render(program)


def test_chains_of_any_length_and_depth(spark):
    """References through more than 64 assignments, and through more than 64 blocks."""
    long = [("x0", 7)] + [(f"x{i}", f"x{i - 1}") for i in range(1, 80)]
    deep = [("y", "base"), ("z", "none")]
    for _ in range(70):
        deep = [deep]
    programs = [long, [("base", 5), *deep]]
    docs = spark.createDataFrame([(i, render(p)) for i, p in enumerate(programs)], "doc_id long, text string")
    p = parse.parse(docs, grammars.chain_syntax(), ("node", "cap"))
    got = chains.resolve(parse.nodes(p), parse.captures(p)).collect()
    assert {(r["key"], r["value"], r["status"]) for r in got if r["doc_id"] == 0} == {(f"x{i}", "7", "number") for i in range(80)}
    assert {(r["key"], r["value"], r["status"]) for r in got if r["doc_id"] == 1} == {("base", "5", "number"), ("y", "5", "number"), ("z", None, "broken")}


def test_modules(spark):
    texts = ["a = 1; b = n1::x; c = n2::none; d = n0::d; a = 5; bad = ;", "x = n0::a; y = n1::z; z = n1::y; w = n9::q;", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "doc_id long, name string")
    p = parse.parse(docs, grammars.module_syntax(), ("node", "cap"))
    got = {f"{r['module']}.{r['key']}": (r["status"], r["value"]) for r in modules.resolve(modules.definitions(parse.nodes(p), parse.captures(p), names)).collect()}
    assert got == {
        "n0.a": ("number", "5"), "n0.b": ("number", "5"), "n0.c": ("unresolved", None), "n0.d": ("recursive", None),
        "n1.x": ("number", "5"), "n1.y": ("recursive", None), "n1.z": ("recursive", None), "n1.w": ("unresolved", None),
    }


def test_texts_and_rows_resolve_alike(spark):
    """Programs parsed and resolved in one kernel: broken ones, names of other blocks, deep ones, null texts."""
    rng = random.Random(9)
    texts = [render(make(rng)) for _ in range(40)]
    texts += [t.replace(c, "", 1) for t in texts[:10] for c in ";={}"] + ["{ a = 1; { a = 2; } { b = a; } c = a; }", "{ = 5; a = ; b = a; }", "", None, "{ 7 }"]
    deep = [("y", "base")]
    for _ in range(400):
        deep = [("own", "base"), deep]
    texts.append(render([("base", 5), deep]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = parse.parse(docs, grammars.chain_syntax(), ("node", "cap"))
    columns = ("doc_id", "key_id", "key", "value", "status")
    rows = sorted(map(tuple, chains.resolve(parse.nodes(p), parse.captures(p)).select(*columns).collect()))
    assert sorted(map(tuple, chains.resolve_documents(docs).select(*columns).collect())) == rows
    assert sum(r[3] == "5" for r in rows if r[0] == len(texts) - 1) == 402


def test_a_tree_is_made_once_per_sequence_of_tokens(spark):
    """Texts that differ in names and numbers only are parsed once; rows are those of a parse of each text."""
    grammar, made = grammars.chain_syntax(), []
    trees = parse.Trees(grammar, lambda rules: made.append(rules) or len(made))
    assert [trees.of(f"{{ k{i} = {i * 37}; }}")[0] for i in range(50)] == [1] * 50
    assert trees.of("{ k = k; }")[0] == 2 and len(made) == 2
    texts = ["{ ab = 1; { c = ab; } }", "{ x = 12345; { yy = x; } }", "{ ab = 1; { c = ; } } }", "", "{ é = 1; }"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [r.asDict() for r in parse.parse(docs, grammar, ("node", "cap")).collect()]
    names = [n for n, _ in parse.FIELDS]
    want = [{n: r.get(n) for n in names} | {"doc_id": i} for i, t in enumerate(texts) for r in parse.tree_rows(grammar, t, frozenset({"node", "cap"}))]
    assert got == want
