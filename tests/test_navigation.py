import json
import random

from pyspark.sql import functions as F

from textloom import grammars
from textloom.functions import positions
from textloom.operators import lex, navigate, parse, relational


def parsed(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return parse.parse(docs, grammars.json_syntax(), ("node", "cap", "err"))


def test_navigation(spark):
    p = parsed(spark, json.dumps({"a": [1, 2, {"b": None}], "c": "x"})).cache()
    n, c = parse.nodes(p), parse.captures(p)
    assert navigate.well_formed_intervals(n).count() == 0
    kids = navigate.children(c).where("kind = 'node'").groupBy("node_id").count()
    assert kids.count() > 0
    sib = {r["node_id"]: r for r in navigate.siblings(n).collect()}
    members = [i for i, r in sorted(sib.items()) if r["name"] == "Member" and r["depth"] == 2]
    assert sib[members[0]]["next_sibling"] == members[1] and sib[members[1]]["prev_sibling"] == members[0]
    assert sib[0]["prev_sibling"] is None and sib[0]["next_sibling"] is None
    scoped = {r["node_id"]: r["scope_id"] for r in navigate.scopes(n, ("Object",)).collect()}
    inner = [r["node_id"] for r in n.where("name = 'Null'").collect()]
    outer = [r["node_id"] for r in n.where("name = 'Object'").orderBy("pre").collect()]
    assert scoped[inner[0]] == outer[1] and scoped[outer[1]] == outer[0] and scoped[0] is None
    span = n.where("name = 'Null'").select("doc_id", "start", "end")
    assert navigate.cover(n, span).first()["name"] == "Null"
    far = spark.createDataFrame([(0, 500, 600)], "doc_id long, start int, end int")
    assert navigate.cover(n, far).first()["node_id"] == 0


def test_branches_equal_pairs(spark):
    """Sweeps over a branch give what comparing all pairs of nodes gives, on random trees, filtered ones too."""
    rng = random.Random(5)

    def value(deep):
        kind = rng.random()
        if deep == 0 or kind < 0.3:
            return rng.choice([1, "x", None, True, {}, []])
        return [value(deep - 1) for _ in range(rng.randint(0, 3))] if kind < 0.6 else {f"k{i}": value(deep - 1) for i in range(rng.randint(0, 3))}

    texts = [json.dumps({"a": value(5), "b": value(4)}) for _ in range(8)] + ["{", "", '{"a" [1, {}]}', "[]"]
    p = parsed(spark, *texts).cache()
    n = parse.nodes(p)
    rows = n.collect()
    trees = {}
    for r in rows:
        if r["pre"] is not None:
            trees.setdefault(r["doc_id"], []).append(r)
    pairs = {(d, a["node_id"], x["node_id"]) for d, t in trees.items() for a in t for x in t if a["pre"] < x["pre"] <= a["post"]}
    assert {(r["doc_id"], r["ancestor_id"], r["node_id"]) for r in navigate.descendants(n).collect()} == pairs
    own = {(d, x["node_id"], x["node_id"]) for d, t in trees.items() for x in t}
    got = navigate.descendants(n, proper=False).collect()
    assert {(r["doc_id"], r["ancestor_id"], r["node_id"]) for r in got} == pairs | own and len(got) == len(pairs | own)
    by = {(r["doc_id"], r["node_id"]): r for r in rows}
    up = lambda r: sorted((by[d, a] for d, a, x in pairs if (d, x) == (r["doc_id"], r["node_id"])), key=lambda a: a["depth"])
    scope = {(r["doc_id"], r["node_id"]): ([a["node_id"] for a in up(r) if a["name"] in ("Object", "Array")] or [None])[-1] for r in rows}
    assert {(r["doc_id"], r["node_id"]): r["scope_id"] for r in navigate.scopes(n, ("Object", "Array")).collect()} == scope
    some = n.where("name IN ('Member', 'Array')")
    want = {(r["doc_id"], r["node_id"]): "/".join(f"{a['name']}{a['node_id']}" for a in [*up(r), r] if a["name"] in ("Member", "Array")) for r in rows if r["name"] in ("Member", "Array") and r["pre"] is not None}
    assert {(r["doc_id"], r["node_id"]): r["path"] for r in navigate.paths(some, F.concat("name", "node_id")).collect()} == want
    spans = [(d, a, a + w) for d, text in enumerate(texts) for a in range(0, len(text) + 1, 3) for w in (0, 2, 9)] * 2
    met = navigate.cover(n, spark.createDataFrame(spans, "doc_id long, start int, end int")).collect()
    assert len(met) == len(set(spans))
    for r in met:
        inside = [x for x in rows if x["doc_id"] == r["doc_id"] and x["start"] is not None and x["start"] <= r["start"] and x["end"] >= r["end"]]
        deepest = max((x["depth"] or 0 for x in inside), default=0)
        assert (by[r["doc_id"], r["node_id"]]["depth"] or 0) == deepest
        assert r["node_id"] in {x["node_id"] for x in inside} | {0}


def test_a_deep_tree_is_read_once(spark):
    """A chain of 20,000 nodes with a span at each: work along the branch, not over pairs."""
    k = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") % 5000 == 0, "Scope").otherwise("N").alias("name"), F.col("id").cast("int").alias("pre"), F.lit(19999).alias("post"), F.col("id").cast("int").alias("depth"), F.col("id").cast("int").alias("start"), (40000 - F.col("id")).cast("int").alias("end"))
    s = navigate.scopes(k, ("Scope",)).groupBy("scope_id").count().collect()
    assert {r["scope_id"]: r["count"] for r in s} == {None: 1, 0: 5000, 5000: 5000, 10000: 5000, 15000: 4999}
    c = navigate.cover(k, k.select("doc_id", "start", "end"))
    assert c.where("node_id <> start").count() == 0 and c.count() == 20000


def test_positions(spark):
    texts = ["", "\n", "ab\ncd\r\n", "щ😀\nx", "one line"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for site in (0, 1, 2, 3, 5, 99):
        t, s = F.col("text"), F.lit(site)
        got = docs.select("doc_id", positions.line_of(t, s).alias("l"), positions.column_of(t, s).alias("c"), positions.byte_index(t, s).alias("b")).orderBy("doc_id").collect()
        back = docs.select("doc_id", positions.site_of(t, positions.line_of(t, s), positions.column_of(t, s)).alias("s")).orderBy("doc_id").collect()
        for text, r, b in zip(texts, got, back, strict=True):
            at = min(site, len(text))
            before = text[:at]
            assert (r["l"], r["c"], r["b"]) == (before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1, len(before.encode()))
            assert b["s"] == at
    clamp = docs.select("doc_id", positions.site_of(F.col("text"), F.lit(99), F.lit(99)).alias("s"), positions.site_of(F.col("text"), F.lit(0), F.lit(0)).alias("z")).orderBy("doc_id").collect()
    assert [r["s"] for r in clamp] == [len(t) for t in texts] and all(r["z"] == 0 for r in clamp)
    starts = docs.select(positions.line_starts(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in starts][2] == [0, 3, 7]


def test_token_lookup(spark):
    docs = spark.createDataFrame([(1, '{"a": 1}')], "doc_id long, text string")
    tok = lex.lex(docs, grammars.json_lexis())
    sites = spark.createDataFrame([(1, 0), (1, 2), (1, 8)], "doc_id long, site long")
    assert [r["name"] for r in lex.token_at(tok, sites).orderBy("site").collect()] == ["BraceOpen", "String", None]
    assert lex.lookahead(tok, 1) is not None


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["asof_v"] for r in relational.asof_join(left, right, "k", "t", "v").collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}
    points = spark.createDataFrame([(0.5,), (3.0,), (7.9,)], "x double")
    ranges = spark.createDataFrame([("p", 0.0, 3.0), ("q", 2.5, 8.0)], "id string, low double, high double")
    got = {(r["x"], r["id"]) for r in relational.range_join(points, ranges, "x", "low", "high", 2.0).collect()}
    assert got == {(0.5, "p"), (3.0, "q"), (7.9, "q")}


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.queries().keys() >= e.oracle_sql().keys()
    assert e.entry(spark).count() > 0


def test_scopes_of_the_grammar_come_with_the_tree(spark):
    """scope_id of the kernel is that of the sweep, and only columns asked for leave the kernel."""
    texts = ["{ a = 1; { b = a; { c = b; } d = a; } e = 1; }", "{ a = ; } }", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = parse.nodes(parse.parse(docs, grammars.chain_syntax(), ("node",), ("id", "name", "scope_id")))
    assert asked.columns == ["doc_id", "node_id", "name", "scope_id"]
    swept = navigate.scopes(parse.nodes(parse.parse(docs, grammars.chain_syntax(), ("node",))), ("Block",)).select(*asked.columns)
    assert sorted(map(repr, asked.collect())) == sorted(map(repr, swept.collect()))
