"""Pretty printing after Oppen (1979): a scan queue learns how wide each group is, a print stack chooses its breaks.

Consistent boxes break all their blanks or none, inconsistent ones fill lines. Widths are UTF-8 byte lengths. After a
break the space left is the larger of the inline width and what the margin leaves.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

FAR = 1 << 30
NEVER = FAR


@dataclass
class _Item:
    kind: str  # word, break, begin, end
    text: str = ""
    size: int = 0
    indent: int = 0
    consistent: bool = False
    pre: str = ""  # printed before a taken break


class Printer:
    """Words, blanks and boxes in, formatted text out. margin, least inline width and indent of a box."""

    def __init__(self, margin: int = 80, inline: int = 60, indent: int = 4):
        self.margin, self.inline, self.step = margin, inline, indent
        self.items: list[_Item] = []
        self.space_next = False

    def ibox(self, indent: int = 0) -> None:
        self.items.append(_Item("begin", indent=indent * self.step))

    def cbox(self, indent: int = 1) -> None:
        self.items.append(_Item("begin", indent=indent * self.step, consistent=True))

    def end(self) -> None:
        self.items.append(_Item("end"))

    def word(self, text: str) -> None:
        if self.items and self.items[-1].kind == "word":
            self.items[-1].text += text
        elif text:
            self.items.append(_Item("word", text))

    def _break(self, text: str, size: int = 0) -> None:
        self.items.append(_Item("break", text, size))

    def blank(self) -> None:
        self._break(" ")

    def softbreak(self) -> None:
        self._break("")

    def hardbreak(self) -> None:
        self._break("", FAR)

    def neverbreak(self) -> None:
        """A place that never breaks: its group counts as one line wide there."""
        self.items.append(_Item("never"))

    def indent(self, steps: int) -> None:
        """Extra indent of the break before."""
        self._last_break().indent = steps * self.step

    def pre_break(self, text: str) -> None:
        """Text that is printed before the newline if the break before is taken."""
        self._last_break().pre = text

    def pre_space(self, text: str) -> None:
        """Text that replaces the space of the break before if it isn't taken."""
        self._last_break().text = text

    def _last_break(self) -> _Item:
        return next(x for x in reversed(self.items) if x.kind == "break")

    def finish(self) -> str:
        sizes = self._measure()
        out: list[str] = []
        left = self.margin
        frames: list[tuple[int, bool, bool]] = []  # indent, breaks, consistent
        indent = 0
        for i, x in enumerate(self.items):
            if x.kind == "word":
                out.append(x.text)
                left -= _width(x.text)
            elif x.kind == "begin":
                fits = sizes[i] <= left
                frames.append((indent, not fits, x.consistent))
                if not fits:
                    indent += x.indent
            elif x.kind == "end":
                indent = frames.pop()[0] if frames else 0
            elif x.kind == "break":
                _, breaks, consistent = frames[-1] if frames else (0, True, False)
                if breaks and consistent or sizes[i] > left and (breaks or x.size >= FAR) or x.size >= FAR:
                    out.append(x.pre)
                    while out and out[-1].strip(" ") == "" and out[-1] and not out[-1].startswith("\n"):
                        out.pop()
                    at = max(0, indent + x.indent)
                    out.append("\n" + " " * at)
                    left = max(self.inline, self.margin - at)
                else:
                    out.append(x.text)
                    left -= _width(x.text)
        return "".join(out)

    def _measure(self) -> list[int]:
        """Size of each group to its end, and of each break with what follows up to the next break or end of its group."""
        sizes = [0] * len(self.items)
        stack: deque[int] = deque()
        total = 0
        for i, x in enumerate(self.items):
            if x.kind == "begin":
                sizes[i] = -total
                stack.append(i)
            elif x.kind in ("break", "end"):
                if stack and self.items[stack[-1]].kind == "break":
                    sizes[stack.pop()] += total
                if x.kind == "end":
                    if stack:
                        sizes[stack.pop()] += total
                else:
                    sizes[i] = -total
                    stack.append(i)
                    total += FAR if x.size >= FAR else _width(x.text)
            elif x.kind == "word":
                total += _width(x.text)
        while stack:
            sizes[stack.pop()] += total
        return sizes


def _width(text: str) -> int:
    return len(text.encode())


def format_json(text: str) -> str:
    """JSON laid out: objects as consistent boxes, arrays as inconsistent ones; malformed text line by line as it is."""
    from ..grammars import json_syntax
    from ..plans.syntax import Session

    g = json_syntax()
    tokens = list(g.lexical.scan(text))
    s = Session(g, tokens, len(text))
    s.parse()
    p = Printer()
    if s.errors:
        for k, line in enumerate(text.split("\n")):
            if k:
                p.hardbreak()
            p.word(line.strip())
        return p.finish()
    string = lambda ref: text[tokens[ref[1]][1] : tokens[ref[1]][1] + tokens[ref[1]][2]]
    # An explicit stack of things to print, so that deep nesting needs no recursion.
    stack: list = [("node", s.nodes[0].captures["document"][1])]
    while stack:
        item = stack.pop()
        if item[0] != "node":
            getattr(p, item[0])(*item[1:])
            continue
        n = s.nodes[item[1]]
        name = g.rules[n.rule].name
        if name in ("Object", "Array"):
            children = n.captures["members" if name == "Object" else "elements"]
            a, b = ("{", "}") if name == "Object" else ("[", "]")
            if not children:
                p.word(a + b)
                continue
            todo: list = [("cbox" if name == "Object" else "ibox", 1), ("word", a), ("blank",) if name == "Object" else ("softbreak",)]
            for k, ref in enumerate(children):
                if k:
                    todo += [("word", ","), ("blank",)]
                todo.append(("node", ref[1]))
            todo += [("blank",) if name == "Object" else ("softbreak",), ("indent", -1), ("word", b), ("end",)]
            stack += reversed(todo)
        elif name == "Member":
            stack += reversed([("word", string(n.captures["key"])), ("word", ": "), ("node", n.captures["value"][1])])
        else:
            p.word(string(n.captures["value"]))
    return p.finish()
