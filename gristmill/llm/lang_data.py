"""JSON and TOML: lexical passes and grammars."""

from __future__ import annotations

import re

from .peg import Peg

JSON = r"""
file <- value '$'
value <- { 'S' '0' 'K' } / '{' ( 'S' ':' value ( ',' 'S' ':' value )* )? '}' / '[' ( value ( ',' value )* )? ']'
"""
_JSON = Peg(JSON, "file")
_JTOK = re.compile(
    r'("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|((?:true|false|null)(?!\w))|([{}\[\]:,])|[ \t\r\n]+|(.)',
    re.S,
)
_GROUPS = (None, "S", "0", "K", None, "?")


def parse_json(text: str) -> tuple[bool, int, str]:
    """(parses, code-point offset of the furthest failure, what was missing)."""
    kinds, at = [], []
    for m in _JTOK.finditer(text):
        g = m.lastindex
        if g:
            kinds.append(_GROUPS[g] or m.group())
            at.append(m.start())
    if kinds and kinds[0] == "?" and at[0] == 0 and text[0] == "﻿":
        del kinds[0], at[0]
    ok, far = _JSON.match([*kinds, "$"])
    if ok:
        return True, 0, ""
    return False, at[far] if far < len(at) else -1, "value"


TOML = r"""
line <- ( pair / '[[' key ']]' / '[' key ']' ) '$'
pair <- key '=' value
key <- part ( '.' part )*
part <- { 'B' 'S' }
value <- { 'S' 'M' 'V' } / '[' ( value ( ',' value )* ','? )? ']' / '{' ( pair ( ',' pair )* )? '}'
"""
_TOML = Peg(TOML, "line")
_TSTR = (
    r'("""(?:[^\\"\x00-\x08\x0b\x0c\x0e-\x1f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\n)|"{1,2}(?!"))*"{0,2}"""'
    r"|'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f]|'{1,2}(?!'))*'{0,2}''')"
    r'|("(?!"")(?:[^\\"\n\x00-\x08\x0b-\x1f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|""'
    r"|'(?!'')[^'\n\x00-\x08\x0b-\x1f]*'|'')"
)
_TVALUE = (
    r"((?:true|false|[+-]?(?:inf|nan)|\d{4}-(?:0\d|1[0-2])-[0-3]\d(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?"
    r"|(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?=[\s,\]}#]|$))"
)
_TCOMMON = r"|(#[^\n\x00-\x08\x0b-\x1f]*)|(\n)|[ \t]+|"
_IN_KEY = re.compile(_TSTR + r"|([A-Za-z0-9_-]+)" + _TCOMMON + r"(\[\[|\]\]|[\[\]{}=.,]|.)", re.S)
_IN_VALUE = re.compile(_TSTR + r"|" + _TVALUE + _TCOMMON + r"([\[\]{},]|.)", re.S)


_SURROGATE = re.compile(r"\\(?:u|U0000)[dD][89a-fA-F][0-9a-fA-F]{2}")
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([btnfr"\\]))')


def _key_part(said: str) -> str:
    """A part of a key as it is meant: without quotes and escapes."""
    if said[0] == "'":
        return said[1:-1]
    if said[0] == '"':
        plain = dict(zip('btnfr"\\', '\b\t\n\f\r"\\'))
        return _ESCAPE.sub(lambda m: plain[m[3]] if m[3] else chr(int(m[1] or m[2], 16)), said[1:-1])
    return said


class _Table(dict):
    """Keys of a table. ``how``: "path" (only passed through), "header", "dotted" or "closed" (an inline value)."""

    def __init__(self, how: str):
        self.how = how


class _Tables:
    """What a TOML document has defined so far: no key twice, no table opened twice or from two sides."""

    def __init__(self) -> None:
        self.root = self.now = _Table("header")
        self.mine: set[int] = set()  # tables made by dotted keys below the present header

    def take(self, toks: list[str], said: list[str]) -> bool:
        if toks[0] in ("[", "[["):
            return self._header([_key_part(x) for t, x in zip(toks, said) if t in "BS"], toks[0] == "[[")
        return self._pair(self.now, toks, said, 0)[0]

    def _header(self, path: list[str], many: bool) -> bool:
        at = self.root
        for part in path[:-1]:
            at = at.setdefault(part, _Table("path"))
            if isinstance(at, list):
                at = at[-1]
            if not isinstance(at, _Table) or at.how == "closed":
                return False
        self.mine = set()
        old = at.get(path[-1])
        if many:
            if old is None:
                old = at[path[-1]] = []
            if not isinstance(old, list):
                return False
            old.append(_Table("header"))
            self.now = old[-1]
            return True
        if old is None:
            old = at[path[-1]] = _Table("header")
        elif not isinstance(old, _Table) or old.how != "path":
            return False
        old.how = "header"
        self.now = old
        return True

    def _pair(self, table: _Table, toks: list[str], said: list[str], i: int) -> tuple[bool, int]:
        """Whether the pair that begins at token i defines something new; the token after it."""
        path = []
        while toks[i] != "=":
            if toks[i] != ".":
                path.append(_key_part(said[i]))
            i += 1
        for part in path[:-1]:
            if part not in table:
                table[part] = _Table("dotted")
                self.mine.add(id(table[part]))
            table = table[part]
            if not isinstance(table, _Table) or id(table) not in self.mine and table.how != "path":
                return False, i
            if table.how == "path":
                table.how = "dotted"
                self.mine.add(id(table))
        if path[-1] in table:
            return False, i
        made = table[path[-1]] = _Table("closed")
        return self._value(made, toks, said, i + 1)

    def _value(self, made: _Table, toks: list[str], said: list[str], i: int) -> tuple[bool, int]:
        """Checks inline tables within a value; nesting is kept on a list."""
        todo = [("{" if toks[i] == "{" else "[" if toks[i] == "[" else "", made)]
        if not todo[0][0]:
            return True, i + 1
        i += 1
        while todo:
            kind, table = todo[-1]
            t = toks[i]
            if t in ("}", "]"):
                todo.pop()
                i += 1
            elif t == ",":
                i += 1
            elif kind == "{":
                path = []
                while toks[i] != "=":
                    if toks[i] != ".":
                        path.append(_key_part(said[i]))
                    i += 1
                for part in path[:-1]:
                    table = table.setdefault(part, _Table("dotted"))
                    if table.how != "dotted":
                        return False, i
                if path[-1] in table:
                    return False, i
                inner = table[path[-1]] = _Table("closed")
                i += 1
                if toks[i] in "{[":
                    todo.append((toks[i], inner))
                i += 1
            else:
                if t in "{[":
                    todo.append((t, _Table("closed")))
                i += 1
        return True, i


def parse_toml(text: str) -> tuple[bool, int, str]:
    """As :func:`parse_json`. A newline ends an expression except inside an array; keys and tables are defined once."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    pos, n = 1 if text.startswith("﻿") else 0, len(text)
    toks: list[str] = []
    at: list[int] = []
    said: list[str] = []
    tables = _Tables()
    stack: list[str] = []
    value = False
    while pos <= n:
        m = (_IN_VALUE if value else _IN_KEY).match(text, pos) if pos < n else None
        g = m.lastindex if m else 5
        if g is None:
            pos = m.end()
            continue
        t = m.group() if m else "\n"
        start, pos = pos, m.end() if m else n + 1
        if g == 4:
            continue
        if g == 5:
            if pos > n and stack:
                return False, -1, "closing bracket"
            if stack and stack[-1] == "[":
                continue
            if toks:
                ok, far = _TOML.match([*toks, "$"])
                if not ok:
                    return False, at[far] if far < len(at) else start if start < len(text.rstrip()) else -1, "key or value"
                if not tables.take(toks, said):
                    return False, at[0], "second definition"
            toks, at, said, stack, value = [], [], [], [], False
            continue
        if g == 1:
            t = "M"
        elif g == 2:
            if _SURROGATE.search(t):
                return False, start, "character"
            t = "S"
        elif g == 3:
            t = "V" if value else "B"
        elif t in "[{" and (value or toks):
            stack.append(t)
            value = t == "["
        elif t in ("]", "}", "]]") and stack:
            stack.pop()
            value = bool(stack) and stack[-1] == "["
        elif t == "=":
            value = True
        elif t == "," and stack:
            value = stack[-1] == "["
        if value and t == "M" and not stack:
            value = True
        toks.append(t)
        at.append(start)
        said.append(text[start:pos])
    return True, 0, ""
