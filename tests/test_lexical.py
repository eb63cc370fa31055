import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import grammars
from textloom.operators import lex
from textloom.plans.automata import GrammarError
from textloom.plans.lexical import LexicalGrammar, NodeSet, TokenRule, TokenSet


def lexed(g, text):
    return [(g.names[r], text[a : a + n]) for r, a, n in g.scan(text)]


def test_longest_match_then_priority():
    g = LexicalGrammar("t", [TokenRule("If", '"if"', priority=1), TokenRule("Name", "['a'..'z']+"), TokenRule("Blank", "' '+")])
    assert lexed(g, "if iffy") == [("If", "if"), ("Blank", " "), ("Name", "iffy")]


def test_mismatches_gather():
    g = LexicalGrammar("t", [TokenRule("A", "'a'+")])
    assert lexed(g, "??a!!") == [("Mismatch", "??"), ("A", "a"), ("Mismatch", "!!")]
    assert lexed(g, "") == []


def test_backs_up_to_the_last_match():
    g = LexicalGrammar("t", [TokenRule("A", '"a"'), TokenRule("Long", '"abcd"')])
    assert lexed(g, "abcabcd") == [("A", "a"), ("Mismatch", "bc"), ("Long", "abcd")]


@pytest.mark.parametrize(
    "rules",
    [
        [TokenRule("A", "'a'*")],
        [TokenRule("A", '"x"'), TokenRule("B", '"x"')],
        [TokenRule("A", "['a'..'z']+", priority=2), TokenRule("B", '"if"', priority=1)],
        [TokenRule("A", "missing")],
        [TokenRule("A", "['z'..'a']")],
        [TokenRule("A", "'a'"), TokenRule("A", "'b'")],
        [TokenRule("A", "$nonsense")],
    ],
)
def test_bad_grammars(rules):
    with pytest.raises(GrammarError):
        LexicalGrammar("bad", rules)


def test_operators():
    g = LexicalGrammar("t", [TokenRule("Any", "'<' . '>'"), TokenRule("Not", "^['<', 'a'..'z', 'A'..'Z']"), TokenRule("Word", 'i("select")'), TokenRule("Two", "'x' & ('y' | 'z')?")])
    assert lexed(g, "<q>1SeLectxyx") == [("Any", "<q>"), ("Not", "1"), ("Word", "SeLect"), ("Two", "xy"), ("Two", "x")]


def test_classes():
    g = grammars.letter_lexis()
    assert lexed(g, "щ😀 12é") == [("Word", "щ"), ("Mismatch", "😀"), ("Blank", " "), ("Digits", "12"), ("Word", "é")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='{}[]:, \n"\\truefalsn0123456789.-+eEuéABF', max_size=60))
def test_tokens_tile(text):
    at = 0
    for _, start, n in grammars.json_lexis().scan(text):
        assert start == at and n > 0
        at += n
    assert at == len(text)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab cd\n1é", max_size=40))
def test_pattern_gives_the_same_words(text):
    import re

    pieces = [m[0] for m in re.finditer(r"(?s)[a-zA-Z]+|[ \n\t\r]+|.", text)]
    merged: list[str] = []
    odd = False
    for p in pieces:
        now = not re.fullmatch(r"[a-zA-Z]+|[ \n\t\r]+", p)
        if now and odd:
            merged[-1] += p
        else:
            merged.append(p)
        odd = now
    assert [s for _, s in lexed(grammars.word_lexis(), text)] == merged


def test_lines():
    assert lexed(grammars.LINES, "a\n\nb") == [("Line", "a\n"), ("Line", "\n"), ("Line", "b")]
    assert lexed(grammars.LINES, "a\n") == [("Line", "a\n")]


def test_token_sets():
    a = TokenSet.inclusive([1, 5]).include(7)
    assert list(a) == [1, 5, 7] and len(a.invert()) == 253 and 5 in a and 6 not in a
    assert a.exclude(5).union(TokenSet.inclusive([9])) == TokenSet.inclusive([1, 7, 9])
    assert a.intersect(TokenSet.exclusive([1])) == TokenSet.inclusive([5, 7])
    assert TokenSet().is_empty() and TokenSet.all().invert().is_empty()
    with pytest.raises(GrammarError):
        NodeSet.inclusive(range(17))


def test_sql_path_equals_kernel(spark):
    from textloom.operators import lex

    docs = spark.createDataFrame([(1, '{"k": [1, -2.5e3, "é\\n", true]}'), (2, "{]?? nul \n"), (3, ""), (4, None)], "doc_id long, text string")
    a = lex.lex(docs, grammars.json_lexis()).drop("rule").collect()
    b = lex.lex_sql(docs, "|".join(grammars.JSON_SQL.values()), grammars.JSON_SQL).collect()
    names = ["doc_id", "tok_idx", "name", "string", "start", "length", "byte_start"]
    assert sorted(tuple(r[n] for n in names) for r in a) == sorted(tuple(r[n] for n in names) for r in b)


def test_sql_path_takes_very_long_strings(spark):
    from textloom.operators import lex

    plain, escapes = '{"k": "' + "x" * 1_000_000 + '"}', '{"k": "' + "\\n\\u00E9" * 100_000 + '"}'
    docs = spark.createDataFrame([(1, plain), (2, escapes), (3, "?" * 300_000), (4, '"' + "open " * 50_000)], "doc_id long, text string")
    cols = ("doc_id", "tok_idx", "name", "start", "length")
    a = lex.lex(docs, grammars.json_lexis(), cols).collect()
    b = lex.lex_sql(docs, "|".join(grammars.JSON_SQL.values()), grammars.JSON_SQL).select(*cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert [r["length"] for r in a if r["name"] == "String"] == [3, 1_000_002, 3, 800_002]


def test_columns_of_the_kernel(spark):
    from textloom.operators import lex

    docs = spark.createDataFrame([(1, "añb 漢 c"), (2, None), (3, "")], "doc_id long, text string")
    whole = lex.lex(docs, grammars.word_lexis())
    assert lex.lex(docs, grammars.word_lexis(), ("name", "byte_start")).columns == ["name", "byte_start"]
    assert [r["byte_start"] for r in whole.orderBy("start").collect()] == [0, 1, 3, 4, 5, 8, 9]
    assert lex.lex(docs, grammars.word_lexis(), automaton=True).collect() == whole.collect()


def test_patterns_that_find_other_tokens_are_refused():
    rules = [TokenRule("Less", "'<'"), TokenRule("Arrow", '"<-"')]
    LexicalGrammar("right", rules, patterns={"Arrow": "<-", "Less": "<"})
    with pytest.raises(GrammarError):
        LexicalGrammar("shortest first", rules, patterns={"Less": "<", "Arrow": "<-"})
    with pytest.raises(GrammarError):
        LexicalGrammar("too much", rules, patterns={"Arrow": "<-", "Less": "[<>]"})


GRAMMARS = {"json": grammars.json_lexis, "words": grammars.word_lexis, "tags": grammars.tag_lexis, "boolean": lambda: grammars.boolean_syntax().lexical, "chain": lambda: grammars.chain_syntax().lexical, "module": lambda: grammars.module_syntax().lexical}


@pytest.mark.parametrize("name", GRAMMARS)
def test_patterns_are_given(name):
    assert GRAMMARS[name]().patterns


@pytest.mark.parametrize("name", GRAMMARS)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet='{}[]:, \n\t\f"\\truefalsn019.-+eEuéABF<>/ap=;_&|!()', max_size=40) | st.lists(st.sampled_from(["true", "false", "null", "<a ", "</a>", "<b>", "1.5e-3", "-0", '"\\u00AF"', '"x', "::", "a1 = b;", "{", "}", " ", "&", "|"]), max_size=12).map("".join))
def test_patterns_equal_the_automaton(name, text):
    g = GRAMMARS[name]()
    assert list(g.scan(text)) == list(g.scan_states(text))


def test_token_at_site_of_any_length(spark, monkeypatch):
    from textloom import queries

    events = spark.createDataFrame([(1, '{"k": 10}'), (2, '{"k": 1000}'), (3, "{}")], "event_id long, props string")
    monkeypatch.setattr(queries, "table", lambda *_: events)
    got = {tuple(r) for r in queries.json_token_at_site(spark, "").collect()}
    assert got == {(1, 4, "Colon", 4), (2, 5, "Blank", 5), (3, 1, "BraceClose", 1)}


def test_token_counts_equal_rows(spark):
    """Sums in the kernel are those of the token rows, by patterns and by the automaton; so are the arrays of a scan."""
    texts = ["", None, "one two", "éé??ab é", "x" * 3000 + " 12 " * 50, "ab\tcd\n\n??", "??"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in (grammars.word_lexis(), grammars.json_lexis(), grammars.LINES):
        for automaton in (False, True) if hasattr(g, "scan_states") else (False,):
            rows = lex.lex(docs, g, automaton=automaton).groupBy("name").agg(F.count("*").alias("n"), F.sum("length").alias("chars"))
            assert sorted(map(tuple, lex.token_counts(docs, g, automaton).collect())) == sorted(map(tuple, rows.collect()))
    for g in (grammars.word_lexis(), grammars.json_lexis()):
        for text in filter(None, texts):
            assert list(map(tuple, g.arrays(text).T.tolist())) == list(g.scan(text)) == list(g.scan_states(text))


def test_runs_of_classes():
    """Grammars of runs are told from others, and scan alike by runs, by patterns and by states."""
    assert grammars.word_lexis().runs and grammars.letter_lexis().runs and not grammars.json_lexis().runs
    two = LexicalGrammar("two", [TokenRule("Same", "['a'..'c']+ | ['x', 'y']+"), TokenRule("Dot", "'.'")])
    pair = LexicalGrammar("pair", [TokenRule("Same", "['a'..'c']+ | ['x', 'y']+")])
    assert not two.runs and pair.runs

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="abxy .\n9é😀\u0301", max_size=30) | st.text(max_size=30))
    def same(text):
        for g in (grammars.word_lexis(), grammars.letter_lexis(), pair, two):
            assert list(map(tuple, g.arrays(text).T.tolist())) == list(g.scan(text)) == list(g.scan_states(text))

    same()
