from textloom import grammars
from textloom.plans.syntax import Session
from textloom.report.messages import Annotation, JsonHighlighter, Style, message, sanitize, snippet, tree_text
from textloom.report.printer import Printer, format_json


def test_short_json_stays_on_a_line():
    assert format_json('{"k":1}') == '{ "k": 1 }'
    assert format_json("{}") == "{}"


def test_wide_objects_break_all_and_arrays_fill():
    text = '{"first": [' + ", ".join(str(i) for i in range(60)) + '], "second": {"a": 1}}'
    out = format_json(text).split("\n")
    assert out[0] == "{" and out[1].startswith('    "first": [') and out[-1] == "}"
    assert all(len(x) <= 80 for x in out)
    assert out[-2] == '    "second": { "a": 1 }'


def test_formatting_is_stable():
    text = '{"first": [' + ", ".join(str(i) for i in range(60)) + '], "b": {"c": [{}, []]}}'
    once = format_json(text)
    assert format_json(once) == once


def test_malformed_text_stays():
    assert format_json('{"a" 1,\n  x}') == '{"a" 1,\nx}'


def test_printer_boxes():
    p = Printer(margin=10, inline=4, indent=2)
    p.cbox()
    p.word("call(")
    p.softbreak()
    p.word("aaaa,")
    p.blank()
    p.word("bbbb")
    p.softbreak()
    p.indent(-1)
    p.word(")")
    p.end()
    assert p.finish() == "call(\n  aaaa,\n  bbbb\n)"


def test_messages():
    g = grammars.json_syntax()
    text = '{"a" 1}'
    s = Session(g, list(g.lexical.scan(text)), len(text))
    s.parse()
    assert message(g, s.errors[0]) == "missing ':' in member"
    s = Session(g, [], 0)
    s.parse()
    assert message(g, s.errors[0]) == "missing object in Root"
    s = Session(g, list(g.lexical.scan('{')), 1)
    s.parse()
    assert len(message(g, s.errors[0])) <= 80 and "expected" in message(g, s.errors[0])


def test_snippet():
    text = "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine\nten"
    out = snippet(text, [Annotation(4, 7, "here", "primary")], "cap", "sum", around=1)
    assert "^^^ here" in out and " 1 │ one" in out and "four" not in out and "⋮" in out and out.endswith("└─ sum")


def test_styles():
    assert Style(fg="red", bold=True).apply("x") == "\x1b[1;31mx\x1b[0m"
    assert Style(bg=(1, 2, 3)).apply("x") == "\x1b[48;2;1;2;3mx\x1b[0m" and Style().apply("x") == "x"
    assert sanitize(Style(fg="bright_blue").apply("a\x07b")) == "ab"
    assert sanitize(JsonHighlighter()('{"a": 1}')) == '{"a": 1}'


def test_tree_text():
    assert tree_text(grammars.json_syntax(), '{"a" 1}').split("\n")[:4] == ["Root", "  document: Object", "    open: '{'", "    close: '}'"]
    assert "nil" in tree_text(grammars.chain_syntax(), "{ a = ; }") or "value" in tree_text(grammars.chain_syntax(), "{ a = ; }")
