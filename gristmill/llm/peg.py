"""Parsing-expression grammars compiled to packrat parsers.

A grammar is text, one rule a line: ``name <- expression``. Expressions: ``'tok'`` a terminal, ``name`` a
rule, ``a b`` sequence, ``a / b`` ordered choice, ``e*  e+  e?``, ``&e  !e`` predicates, ``( )`` groups and
``@nl`` (true where a line break stands before the token). ``{'a' 'b'}`` is a set of terminals. A rule
written ``name <= ...`` keeps its results in the packrat table. Every rule becomes one Python function
from a position to the position after the match or -1. ``far`` is the furthest token at which any
terminal failed.
"""

from __future__ import annotations

import re
import sys

_TOKEN = re.compile(r"\s*(?:('[^']*')|([A-Za-z_]\w*)|(@nl)|([{}()/*+?&!]))")


class Peg:
    """A compiled grammar. ``match`` asks whether the start rule consumes all tokens."""

    def __init__(self, grammar: str, start: str):
        self.rules: dict[str, tuple] = {}
        self.keep: set[str] = set()
        for line in re.sub(r"\n[ \t]+", " ", grammar.strip()).split("\n"):
            if not line.strip():
                continue
            name, arrow, body = re.match(r"(\w+)\s*(<-|<=)\s*(.*)", line).groups()
            if arrow == "<=":
                self.keep.add(name)
            self.toks = [next(x for x in m.groups() if x) for m in _TOKEN.finditer(body)]
            self.at = 0
            self.rules[name] = self._choice()
            assert self.at == len(self.toks), (name, self.toks[self.at :])
        self.source = self._compile()
        scope: dict = {}
        exec(compile(self.source, f"<peg {start}>", "exec"), scope)  # noqa: S102 - text made from the grammar above
        self._run = scope["run"]
        self.start = start

    # -- reading the grammar -------------------------------------------------------------------------
    def _peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def _next(self) -> str:
        self.at += 1
        return self.toks[self.at - 1]

    def _choice(self) -> tuple:
        options = [self._sequence()]
        while self._peek() == "/":
            self._next()
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() and self._peek() not in ("/", ")"):
            parts.append(self._suffix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def _suffix(self) -> tuple:
        t = self._peek()
        if t in ("&", "!"):
            self._next()
            return ("and" if t == "&" else "not", self._suffix())
        node = self._atom()
        while self._peek() in ("*", "+", "?"):
            node = ({"*": "star", "+": "plus", "?": "opt"}[self._next()], node)
        return node

    def _atom(self) -> tuple:
        t = self._next()
        if t == "(":
            node = self._choice()
            assert self._next() == ")"
            return node
        if t == "{":
            terms = set()
            while self._peek() != "}":
                terms.add(self._next()[1:-1])
            self._next()
            return ("set", frozenset(terms))
        if t == "@nl":
            return ("nl",)
        return ("tok", t[1:-1]) if t[0] == "'" else ("rule", t)

    # -- writing the parser --------------------------------------------------------------------------
    def _compile(self) -> str:
        self.n, self.sets = 0, {}
        body: list[str] = []
        for name, node in self.rules.items():
            body += [f"def r_{name}(p):"]
            body.append("    global far")
            if name in self.keep:
                body += [f"    k = memo_{name}.get(p)", "    if k is not None:", "        return k", "    s = p"]
            code = self._emit(node, 1)
            body += code
            if name in self.keep:
                body.append(f"    memo_{name}[s] = p")
            body.append("    return p")
        head = [f"S{i} = {set(s)!r}" for s, i in self.sets.items()]
        head += [f"memo_{n} = {{}}" for n in self.keep]
        tail = ["def run(tokens, newlines, start):", "    global T, NL, far", "    T, NL, far = tokens, newlines, 0"]
        tail += [f"    memo_{n}.clear()" for n in self.keep]
        tail += ["    p = globals()['r_' + start](0)", "    return p, far"]
        return "\n".join(head + body + tail)

    def _emit(self, node: tuple, d: int) -> list[str]:
        """Lines that move ``p`` behind the match of node, or set it to -1."""
        pad, kind = "    " * d, node[0]
        if kind in ("tok", "set", "nl"):
            if kind == "nl":
                return [f"{pad}if not NL[p]:", f"{pad}    p = -1"]
            cond = f"T[p] == {node[1]!r}" if kind == "tok" else f"T[p] in S{self.sets.setdefault(node[1], len(self.sets))}"
            return [f"{pad}if {cond}:", f"{pad}    p += 1", f"{pad}else:", f"{pad}    if p > far: far = p", f"{pad}    p = -1"]
        if kind == "rule":
            return [f"{pad}p = r_{node[1]}(p)"]
        self.n += 1
        q = f"q{self.n}"
        if kind == "seq":
            out: list[str] = []
            for i, part in enumerate(node[1]):
                if i:
                    out.append(f"{pad}if p >= 0:")
                    pad, d = pad + "    ", d + 1
                out += self._emit(part, d)
            return out
        if kind == "choice":
            out = [f"{pad}{q} = p"]
            for i, part in enumerate(node[1]):
                first = _first(part)
                if i == 0:
                    out += self._emit(part, d)
                    continue
                out += [f"{pad}if p < 0:", f"{pad}    p = {q}"]
                if first is not None and part[0] == "seq":
                    test = f"T[p] in S{self.sets.setdefault(first, len(self.sets))}" if len(first) > 1 else f"T[p] == {next(iter(first))!r}"
                    out += [f"{pad}    if {test}:", *self._emit(part, d + 2), f"{pad}    else:", f"{pad}        if p > far: far = p", f"{pad}        p = -1"]
                else:
                    out += self._emit(part, d + 1)
            return out
        if kind in ("star", "plus"):
            out = []
            if kind == "plus":
                out += self._emit(node[1], d)
                out.append(f"{pad}if p >= 0:")
                pad, d = pad + "    ", d + 1
            out += [f"{pad}while True:", f"{pad}    {q} = p", *self._emit(node[1], d + 1), f"{pad}    if p < 0 or p == {q}:", f"{pad}        p = {q}", f"{pad}        break"]
            return out
        if kind == "opt":
            return [f"{pad}{q} = p", *self._emit(node[1], d), f"{pad}if p < 0: p = {q}"]
        if kind in ("and", "not"):
            return [f"{pad}{q} = p", *self._emit(node[1], d), f"{pad}p = {q} if p {'>=' if kind == 'and' else '<'} 0 else -1"]
        raise AssertionError(kind)

    def match(self, tokens: list[str], newlines: list[bool] | None = None, start: str | None = None) -> tuple[bool, int]:
        """Whether the start rule consumes ``tokens`` (which must end with ``'$'``), and the furthest failure."""
        # calls between rules need no C stack, so the depth may grow with the input
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 64 * len(tokens) + 10_000))
        try:
            end, far = self._run(tokens, newlines, start or self.start)
        finally:
            sys.setrecursionlimit(before)
        if end >= len(tokens) - 1:
            return True, end
        return False, max(far, end, 0)


def _first(node: tuple) -> frozenset | None:
    """The terminals a sequence can begin with, where that is plain to see."""
    if node[0] == "tok":
        return frozenset([node[1]])
    if node[0] == "set":
        return node[1]
    if node[0] == "seq":
        return _first(node[1][0])
    return None
