"""Syntax trees of documents: one kernel pass per document gives node, capture, error and concrete-tree rows.

``parse`` returns one tagged table; ``kinds`` says which rows to make, so that unused ones never leave the kernel.
``nodes``, ``captures``, ``errors`` and ``concrete`` pick theirs. Node ids are in order of entry (0 is the root);
``pre`` and ``post`` are the pre-order rank and the last rank in the subtree, by captures, null for nodes that no
capture reaches. Node spans are those of their first and last captured token in capture order.

Of a text the parser sees the rules of its tokens only, unless a rule is parsed by hand. So texts with the same sequence
of rules have one tree with other sites and strings, and nodes and captures are made once per sequence (``Trees``).
``fold`` goes on inside the kernel, for what looks at one document at a time: no node leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.syntax import ConcreteTree, Session, SyntaxGrammar
from ..session import attach
from .lex import _scanner, slices

FIELDS = [
    ("doc_id", "long"), ("kind", "string"), ("id", "int"), ("rule", "int"), ("name", "string"), ("parent_id", "int"), ("depth", "int"), ("pre", "int"), ("post", "int"),
    ("key", "string"), ("key_ord", "int"), ("pos", "int"), ("ref_kind", "string"), ("ref_id", "int"), ("start", "int"), ("end", "int"), ("tok_from", "int"), ("tok_to", "int"),
    ("context", "int"), ("recovery", "string"), ("expected_tokens", "array<int>"), ("expected_nodes", "array<int>"), ("string", "string"), ("well_formed", "boolean"),
]
#: Given only where it is asked for: the nearest proper ancestor whose rule is a scope.
SCOPE = ("scope_id", "int")
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}
#: Texts of at most SHORT characters are remembered, MEMO of them.
SHORT, MEMO = 256, 2000
#: Trees are remembered by their tokens' rules, of so many tokens together.
REMEMBERED = 100_000
BLANKS = frozenset(" \r\f\t\n")


def tree_rows(grammar: SyntaxGrammar, text: str, kinds: frozenset[str], scoped: bool = False) -> Iterator[dict]:
    """Rows of one document, without doc_id; with ``scoped`` nodes have a scope_id."""
    return _rows(grammar, list(grammar.lexical.scan(text)), text, kinds, scoped)


def _rows(grammar: SyntaxGrammar, tokens: list[tuple[int, int, int]], text, kinds: frozenset[str], scoped: bool) -> Iterator[dict]:
    concrete = ConcreteTree() if "cst" in kinds else None
    events: list[tuple] = []

    def observe(*event) -> None:
        events.append(event)
        if concrete is not None:
            concrete(*event)

    s = Session(grammar, tokens, len(text), observe if "trace" in kinds else concrete)
    s.parse()
    for i, (event, *x) in enumerate(events):
        yield {"kind": "trace", "id": i, "name": event, "ref_id": x[0], "parent_id": x[1] if len(x) > 1 else None}
    spans, order = _spans(s, tokens), _intervals(s)
    names = [r.name for r in grammar.rules]
    if "tok" in kinds:
        for i, (rule, at, n) in enumerate(tokens):
            yield {"kind": "tok", "id": i, "rule": rule, "name": grammar.lexical.names[rule], "start": at, "end": at + n, "string": text[at : at + n]}
    if "node" in kinds:
        placed = {ref[1]: (k, o, p) for n in s.nodes for o, k in enumerate(n.keys) for p, ref in enumerate(_many(n.captures.get(k))) if ref and ref[0] == "node"}
        scope = _scopes(s, order, grammar) if scoped else {}
        for i, n in enumerate(s.nodes):
            depth, pre, post = order.get(i, (None, None, None))
            key, ord_, pos = placed.get(i, (None, None, None))
            yield {"kind": "node", "scope_id": scope.get(i), "id": i, "rule": n.rule, "name": names[n.rule], "parent_id": n.parent if n.parent >= 0 else None, "depth": depth, "pre": pre, "post": post, "key": key, "key_ord": ord_, "pos": pos, "start": spans[i][0], "end": spans[i][1], "tok_from": n.tok_from, "tok_to": n.tok_to}
    if "cap" in kinds:
        for i, n in enumerate(s.nodes):
            for o, k in enumerate(n.keys):
                for p, ref in enumerate(_many(n.captures.get(k))):
                    row = {"kind": "cap", "id": i, "rule": n.rule, "name": names[n.rule], "key": k, "key_ord": o, "pos": p, "ref_kind": ref and ref[0], "ref_id": ref and ref[1]}
                    if ref and ref[0] == "token":
                        rule, at, length = tokens[ref[1]]
                        row |= {"start": at, "end": at + length, "string": text[at : at + length]}
                    yield row
    if "err" in kinds:
        for i, e in enumerate(s.errors):
            a, b = aligned(text, tokens, e["start"], e["end"], e["recovery"] == "insert")
            yield {"kind": "err", "id": i, "start": a, "end": b, "context": e["context"], "name": names[e["context"]], "recovery": e["recovery"], "expected_tokens": e["tokens"], "expected_nodes": e["nodes"]}
    if concrete is not None:
        yield from _concrete(concrete, s, tokens, text, names, grammar)


def _many(v) -> list:
    return v if isinstance(v, list) else [v]


def _refs(n) -> Iterator:
    for k in n.keys:
        yield from _many(n.captures.get(k))


def _spans(s: Session, tokens: list) -> list[tuple]:
    """(start, end) of each node: first capture with a site, last capture with a site. Children come after parents
    in order of entry, except lifted ones, so spans are made depth first."""
    done: dict[int, tuple] = {}
    for root in range(len(s.nodes)):
        stack = [root]
        while stack:
            i = stack[-1]
            if i in done:
                stack.pop()
                continue
            need = [r[1] for r in _refs(s.nodes[i]) if r and r[0] == "node" and r[1] not in done]
            if need:
                stack += need
                continue
            own = [(tokens[r[1]][1], tokens[r[1]][1] + tokens[r[1]][2]) if r[0] == "token" else done[r[1]] for r in _refs(s.nodes[i]) if r]
            own = [x for x in own if x[0] is not None]
            done[i] = (own[0][0], own[-1][1]) if own else (None, None)
            stack.pop()
    return [done[i] for i in range(len(s.nodes))]


def _intervals(s: Session) -> dict[int, tuple[int, int, int]]:
    """depth, pre and post by captures, from the root."""
    if not s.nodes:
        return {}
    out: dict[int, tuple[int, int, int]] = {}
    n = 0
    stack: list[tuple[int, int, bool]] = [(0, 0, False)]
    first: dict[int, int] = {}
    while stack:
        i, depth, left = stack.pop()
        if left:
            out[i] = (depth, first[i], n - 1)
            continue
        first[i] = n
        n += 1
        stack.append((i, depth, True))
        stack += [(r[1], depth + 1, False) for r in reversed(list(_refs(s.nodes[i]))) if r and r[0] == "node"]
    return out


def _scopes(s: Session, order: dict[int, tuple[int, int, int]], grammar: SyntaxGrammar) -> dict[int, int]:
    """The nearest proper ancestor of each node that is a scope, by one pass in order of entry."""
    out: dict[int, int] = {}
    open_: list[tuple[int, int]] = []
    for i, (_, pre, post) in sorted(order.items(), key=lambda x: x[1][1]):
        while open_ and open_[-1][0] < pre:
            open_.pop()
        if open_:
            out[i] = open_[-1][1]
        if grammar.rules[s.nodes[i].rule].scope:
            open_.append((post, i))
    return out


def aligned(text: str, tokens: list, start: int, end: int, insert: bool) -> tuple[int, int]:
    """Insert: widened over blanks on both sides. Else blanks are trimmed; what is empty then moves left over blanks."""
    blank = lambda i: text[i] in BLANKS
    if insert:
        while start > 0 and blank(start - 1):
            start -= 1
        while end < len(text) and blank(end):
            end += 1
        return start, end
    while start < end and blank(start):
        start += 1
    while start < end and blank(end - 1):
        end -= 1
    if start == end:
        while start > 0 and blank(start - 1):
            start -= 1
        end = start
    return start, end


def _concrete(tree: ConcreteTree, s: Session, tokens: list, text: str, names: list[str], grammar: SyntaxGrammar) -> Iterator[dict]:
    """Lossless tree rows in depth-first order: parent, order among siblings, and what each is (node, token or blank)."""
    n = 0
    stack: list[tuple] = [(x, None, k) for k, x in reversed(list(enumerate(_blanks_merged(tree.children[-1], tokens, text))))]
    while stack:
        (kind, ref), parent, ord_ = stack.pop()
        row = {"kind": "cst", "id": n, "parent_id": parent, "pos": ord_, "ref_kind": kind}
        if kind == "node":
            node = s.nodes[ref]
            a = tokens[node.tok_from][1] if node.tok_from < len(tokens) else len(text)
            b = sum(tokens[node.tok_to - 1][1:]) if node.tok_to > node.tok_from else a
            yield row | {"rule": node.rule, "name": names[node.rule], "ref_id": ref, "start": a, "end": b, "well_formed": ref not in tree.broken}
            stack += [(x, n, k) for k, x in reversed(list(enumerate(_blanks_merged(tree.children[ref], tokens, text))))]
        elif kind == "blank":
            yield row | {"name": "Blank", "start": ref[0], "end": ref[1], "string": text[ref[0] : ref[1]], "well_formed": True}
        else:
            rule, at, length = tokens[ref]
            yield row | {"rule": rule, "name": grammar.lexical.names[rule], "ref_id": ref, "start": at, "end": at + length, "string": text[at : at + length], "well_formed": rule != 1}
        n += 1


def _blanks_merged(children: list, tokens: list, text: str) -> list:
    out: list = []
    for kind, ref in children:
        if kind == "token":
            _, at, n = tokens[ref]
            if set(text[at : at + n]) <= BLANKS:
                if out and out[-1][0] == "blank" and out[-1][1][1] == at:
                    out[-1] = ("blank", (out[-1][1][0], at + n))
                else:
                    out.append(("blank", (at, at + n)))
                continue
        out.append((kind, ref))
    return out


class Trees:
    """What ``make`` gives for the tokens of a text, made once per sequence of their rules."""

    def __init__(self, grammar: SyntaxGrammar, make: Callable[[list[int]], object]):
        self.scan, self.make = _scanner(grammar.lexical), make
        self.known: dict[bytes, object] = {}
        self.room = REMEMBERED

    def of(self, text: str) -> tuple[object, np.ndarray, np.ndarray]:
        """With the starts and lengths of the tokens."""
        rules, starts, lengths = self.scan(text)
        key = rules.tobytes()
        found = self.known.get(key)
        if found is None:
            found = self.make(rules.tolist())
            if len(rules) < self.room:
                self.known[key] = found
                self.room -= len(rules) + 1
        return found, starts, lengths


def by_rules_alone(grammar: SyntaxGrammar) -> bool:
    """Is a tree decided by its tokens' rules? A parser made by hand may look at more."""
    return not any(r.parser for r in grammar.rules)


def _numbered(rules: list[int]) -> list[tuple[int, int, int]]:
    """Tokens whose sites are their numbers."""
    return [(r, i, 1) for i, r in enumerate(rules)]


def parse(docs: DataFrame, grammar: SyntaxGrammar, kinds: tuple[str, ...] = ("node", "cap", "err"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Tagged rows of all documents. A null text parses as the empty one. Only doc_id, kind and ``columns`` of the rows
    leave the kernel (all but scope_id by default)."""
    attach(docs.sparkSession)
    wanted = frozenset(kinds)
    fields = FIELDS if columns is None else [f for f in [*FIELDS, SCOPE] if f[0] in {"doc_id", "kind", *columns}]
    names = [n for n, _ in fields[1:]]
    scoped, numbered = SCOPE in fields, wanted <= {"node", "cap"} and by_rules_alone(grammar)

    def make(rules: list[int]) -> list[list]:
        # Start and end are numbers of tokens, the string of token i is range(i, i + 1).
        rows = list(_rows(grammar, _numbered(rules), range(len(rules)), wanted, scoped))
        return [[r.get(n) for r in rows] for n in names]

    def columns_of(text: str, trees: Trees) -> list[list]:
        if not numbered:
            rows = list(tree_rows(grammar, text, wanted, scoped))
            return [[r.get(n) for r in rows] for n in names]
        found, starts, lengths = trees.of(text)
        if not {"start", "end", "string"} & set(names):
            return found
        a = starts.tolist()
        b = (starts + lengths).tolist()
        put = {"start": lambda i: a[i], "end": lambda i: b[i - 1], "string": lambda i: text[a[i[0]] : b[i[0]]]}
        return [[None if i is None else put[n](i) for i in c] if n in put else c for n, c in zip(names, found, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Short texts often come again: their rows are kept, up to MEMO texts.
        memo: dict[str, list[list]] = {}
        trees = Trees(grammar, make)
        for batch in slices(batches, 64):
            ids: list = []
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                own = memo.get(text)
                if own is None:
                    own = columns_of(text, trees)
                    if len(text) <= SHORT and len(memo) < MEMO:
                        memo[text] = own
                ids += [doc] * len(own[0])
                for c, x in zip(cols, own, strict=True):
                    c += x
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, ARROW[t]) for c, (_, t) in zip(cols, fields[1:], strict=True))], [n for n, _ in fields])

    schema = ", ".join(f"{n} {t}" for n, t in fields)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fold(docs: DataFrame, grammar: SyntaxGrammar, plan: Callable[[list[dict]], Callable[[Callable[[int], str]], Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows that a function gives for each document's tree, inside the kernel: doc_id and the columns of ``schema``.

    ``plan`` gets a tree's node and capture rows, where start and end are numbers of tokens and strings are left out. It
    is called once per sequence of token rules, and gives a function from the strings of a text's tokens, by number, to
    the rows. Only for grammars without rules that are parsed by hand. A null text parses as the empty one."""
    attach(docs.sparkSession)
    if not by_rules_alone(grammar):
        raise ValueError(f"{grammar.name} has rules that are parsed by hand")
    types = StructType.fromDDL(f"doc_id long, {schema}")
    kinds = frozenset({"node", "cap"})

    def make(rules: list[int]):
        return plan([r | {"string": None} for r in _rows(grammar, _numbered(rules), range(len(rules)), kinds, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, trees = to_arrow_schema(types), Trees(grammar, make)
        for batch in slices(batches, 64):
            ids: list = []
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                rows_of, starts, lengths = trees.of(text)
                a, b = starts.tolist(), (starts + lengths).tolist()
                before = len(rows)
                rows += rows_of(lambda i: text[a[i] : b[i]])  # noqa: B023 (used at once)
                ids += [doc] * (len(rows) - before)
            cols = [ids, *zip(*rows, strict=True)] if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, types)


def _part(kind: str, names: str):
    columns = names.split()

    def pick(parsed: DataFrame) -> DataFrame:
        there = [c for c in columns if c.split("=")[0] in parsed.columns]
        return parsed.where(F.col("kind") == kind).select(*[F.col(c.split("=")[0]).alias(c.split("=")[-1]) for c in there])

    return pick


tokens = _part("tok", "doc_id id=tok_idx rule name start end string")
nodes = _part("node", "doc_id id=node_id rule name parent_id depth pre post key=cap_key key_ord=cap_ord pos=cap_pos start end tok_from tok_to scope_id")
captures = _part("cap", "doc_id id=node_id name key key_ord pos ref_kind=kind ref_id start end string")
errors = _part("err", "doc_id id=err_id start end context name=context_name recovery expected_tokens expected_nodes")
trace = _part("trace", "doc_id id=seq name=event ref_id parent_id=into")
concrete = _part("cst", "doc_id id=cst_id rule name parent_id=parent pos=ord ref_kind=kind ref_id start end string well_formed")
