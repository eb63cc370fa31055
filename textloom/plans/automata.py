"""Regular expressions over any hashable symbols: Thompson construction, subset construction, minimisation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass


class GrammarError(ValueError):
    """A grammar that can't be compiled."""


@dataclass(frozen=True)
class Sym:
    """One edge; ``value`` is resolved to concrete symbols by the compiler that uses it."""

    value: Hashable


@dataclass(frozen=True)
class Cat:
    items: tuple


@dataclass(frozen=True)
class Alt:
    items: tuple


@dataclass(frozen=True)
class Rep:
    """``low`` or more repeats (0 or 1), at most one if ``once``, with an optional separator."""

    item: object
    low: int
    once: bool = False
    sep: object | None = None


class Nfa:
    def __init__(self) -> None:
        self.eps: dict[int, list[int]] = defaultdict(list)
        self.edges: dict[int, list[tuple[Hashable, int]]] = defaultdict(list)
        self.size = 0

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, expr, symbols: Callable[[Hashable], Iterable[Hashable]]) -> tuple[int, int]:
        """Fragment (start, end) of ``expr``."""
        a, b = self.state(), self.state()
        if isinstance(expr, Sym):
            for s in symbols(expr.value):
                self.edges[a].append((s, b))
        elif isinstance(expr, Cat):
            at = a
            for item in expr.items:
                x, y = self.add(item, symbols)
                self.eps[at].append(x)
                at = y
            self.eps[at].append(b)
        elif isinstance(expr, Alt):
            for item in expr.items:
                x, y = self.add(item, symbols)
                self.eps[a].append(x)
                self.eps[y].append(b)
        elif isinstance(expr, Rep):
            x, y = self.add(expr.item, symbols)
            self.eps[a].append(x)
            self.eps[y].append(b)
            if not expr.low:
                self.eps[a].append(b)
            if not expr.once:
                if expr.sep is None:
                    self.eps[y].append(x)
                else:
                    p, q = self.add(expr.sep, symbols)
                    self.eps[y].append(p)
                    self.eps[q].append(x)
        else:
            raise TypeError(expr)
        return a, b

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """States 0..n-1, 0 the start; ``moves[s][symbol]`` is the next state, ``accepts[s]`` the NFA ends that s holds."""

    moves: list[dict[Hashable, int]]
    accepts: list[frozenset]


def determinize(nfa: Nfa, start: int, ends: dict[int, Hashable]) -> Dfa:
    first = nfa.closure([start])
    index, moves, accepts, todo = {first: 0}, [{}], [], [first]
    accepts.append(frozenset(ends[s] for s in first if s in ends))
    while todo:
        here = todo.pop()
        by: dict[Hashable, set[int]] = defaultdict(set)
        for s in here:
            for symbol, t in nfa.edges.get(s, ()):
                by[symbol].add(t)
        for symbol, targets in by.items():
            to = nfa.closure(targets)
            if to not in index:
                index[to] = len(moves)
                moves.append({})
                accepts.append(frozenset(ends[s] for s in to if s in ends))
                todo.append(to)
            moves[index[here]][symbol] = index[to]
    return Dfa(moves, accepts)


def minimize(dfa: Dfa, accept_of: Callable[[frozenset], Hashable]) -> tuple[list[dict[Hashable, int]], list[Hashable]]:
    """Moves and accept values of the smallest equivalent automaton (partition refinement), start at 0."""
    accept = [accept_of(a) for a in dfa.accepts]
    block = {a: i for i, a in enumerate(dict.fromkeys(accept))}
    part = [block[a] for a in accept]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((part[s], frozenset((x, part[t]) for x, t in dfa.moves[s].items())), len(seen)) for s in range(len(part))]
        if len(seen) == len(set(part)):
            break
        part = new
    order = {p: i for i, p in enumerate(dict.fromkeys([part[0], *part]))}
    moves: list[dict[Hashable, int]] = [{} for _ in order]
    out: list[Hashable] = [None] * len(order)
    for s, p in enumerate(part):
        moves[order[p]] = {x: order[part[t]] for x, t in dfa.moves[s].items()}
        out[order[p]] = accept[s]
    return moves, out
