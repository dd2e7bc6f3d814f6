"""Python: a lexical pass, a grammar for logical lines and a grammar for block structure.

The packrat table for logical lines is keyed by the line's tokens rather than by its position, so it is
shared by all lines of all files that a worker sees; ``LINE_MEMO`` bounds its size.
"""

from __future__ import annotations

import re
import unicodedata

from .peg import Peg

#: The reserved words of Python 3.13.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
#: Names that are words of the grammar only where it asks for them.
SOFT = "match case type".split()

LINE = r"""
line <- header / simples '$'
header <- 'if' named ':' tail / 'elif' named ':' tail / 'else' ':' tail / 'while' named ':' tail / for / 'async' for / 'try' ':' tail / except / 'finally' ':' tail / with / 'async' with / def / 'async' def / class / '@' named '$' / 'match' subject ':' '$' / 'case' patterns ( 'if' named )? ':' tail
tail <- '$' / simples '$'
for <- 'for' targets 'in' stars ':' tail
except <- 'except' '*' exprlist ( 'as' name )? ':' tail / 'except' ( expr 'as' name / expr )? ':' tail
exprlist <- expr
with <- 'with' '(' witem ( ',' witem )* ','? ')' ':' tail / 'with' witem ( ',' witem )* ':' tail
witem <- expr ( 'as' target )?
def <- 'def' name typeparams? '(' params? ')' ( '->' expr )? ':' tail
class <- 'class' name typeparams? ( '(' args? ')' )? ':' tail
typeparams <- '[' tparam ( ',' tparam )* ','? ']'
tparam <- ( '*' / '**' )? name ( ':' expr )? ( '=' ( starred / expr ) )?
params <- plain ( ',' plain )* ( ',' '/' ( ',' plain )* ( ',' dflt )* / ( ',' dflt )* slashd? ) ( ',' starpart )? ','? / dflt ( ',' dflt )* slashd? ( ',' starpart )? ','? / starpart ','?
slashd <- ',' '/' ( ',' dflt )*
plain <- name ( ':' expr )? !'='
dflt <- name ( ':' expr )? '=' expr
anyp <- name ( ':' expr )? ( '=' expr )?
starpart <- '*' name ( ':' ( starred / expr ) )? ( ',' anyp )* ( ',' kwp )? / '*' ( ',' anyp )+ ( ',' kwp )? / kwp
kwp <- '**' name ( ':' expr )?
subject <- starnamed ',' starnameds? / named
starnameds <- starnamed ( ',' starnamed )* ','?
starnamed <- '*' operand binop* / named
patterns <- maybestar ',' ( maybestar ( ',' maybestar )* ','? )? / pattern
maybestar <- '*' name / pattern
pattern <- orpat ( 'as' name )?
orpat <- closed ( '|' closed )*
closed <- '-'? '0' ( { '+' '-' } '0' )? / str / { 'None' 'True' 'False' } / dotted '(' ( pargs )? ')' / dotted / '(' ( patterns )? ')' / '[' ( maybestar ( ',' maybestar )* ','? )? ']' / '{' ( mapitem ( ',' mapitem )* ( ',' '**' name )? ','? / '**' name ','? )? '}'
mapitem <- ( '-'? '0' ( { '+' '-' } '0' )? / str / { 'None' 'True' 'False' } / name ( '.' name )+ ) ':' pattern
pargs <- parg ( ',' parg )* ','?
parg <- name '=' pattern / pattern
dotted <- name ( '.' name )*
simples <- simple ( ';' simple )* ';'?
simple <- { 'pass' 'break' 'continue' } / 'return' stars? / 'raise' ( expr ( 'from' expr )? )? / 'global' name ( ',' name )* / 'nonlocal' name ( ',' name )* / 'del' dels / 'assert' expr ( ',' expr )? / 'import' asname ( ',' asname )* / from / 'type' name typeparams? '=' expr / assign / stars
from <- 'from' { '.' '...' }* dotted 'import' names / 'from' { '.' '...' }+ 'import' names
names <- '*' / '(' fname ( ',' fname )* ','? ')' / fname ( ',' fname )*
fname <- name ( 'as' name )?
asname <- dotted ( 'as' name )?
dels <- del ( ',' del )* ','?
del <- tprim / name / '(' dels? ')' / '[' dels? ']'
assign <- ( targets '=' )+ ( yield / stars ) !'=' / single ':' expr ( '=' ( yield / stars ) )? / single { '+=' '-=' '*=' '/=' '//=' '%=' '@=' '&=' '|=' '^=' '>>=' '<<=' '**=' } ( yield / stars )
single <- tprim / name / '(' single ')'
targets <- startarget ( ',' startarget )* ','?
startarget <- '*' !'*' target / target
target <- tprim / name / '(' targets? ')' / '[' targets? ']'
tprim <= atom ( trailer &trailer )* ( '.' name / '[' slices ']' ) !trailer
trailer <- '.' name / '(' args? ')' / '[' slices ']'
slices <- slice ( ',' slice )* ','?
slice <- starred / expr? ':' expr? ( ':' expr? )? / named
yield <- 'yield' 'from' expr / 'yield' stars?
stars <- starexpr ( ',' starexpr )* ','? / yield
starexpr <- starred / expr
starred <- '*' operand ( binop )*
binop <- { '+' '-' '*' '/' '//' '%' '@' '&' '|' '^' '<<' '>>' '**' } operand
named <- name ':=' expr / expr !':='
expr <= 'lambda' lparams? ':' expr / disj ( 'if' disj 'else' expr )?
lparams <- lplain ( ',' lplain )* ( ',' '/' ( ',' lplain )* ( ',' ldflt )* / ( ',' ldflt )* lslash? ) ( ',' lstar )? ','? / ldflt ( ',' ldflt )* lslash? ( ',' lstar )? ','? / lstar ','?
lslash <- ',' '/' ( ',' ldflt )*
lplain <- name !'='
ldflt <- name '=' expr
lany <- name ( '=' expr )?
lstar <- '*' name ( ',' lany )* ( ',' '**' name )? / '*' ( ',' lany )+ ( ',' '**' name )? / '**' name
disj <- inversion ( { 'or' 'and' } inversion )*
inversion <- 'not'* comparison
comparison <- operand ( binop / compare operand )*
compare <- { '==' '!=' '<' '>' '<=' '>=' 'in' } / 'not' 'in' / 'is' 'not'?
operand <- { '+' '-' '~' }* 'await'? atom trailer*
atom <= name / '0' / str / { 'None' 'True' 'False' '...' } / paren / listd / braced
str <- 'S'+ !'B' / 'B'+ !'S'
paren <- '(' ( yield / named comp / starnamed ',' starnameds? / named )? ')'
listd <- '[' ( named comp / starnameds )? ']'
braced <- '{' ( expr ':' expr comp / dictitem ( ',' dictitem )* ','? / named comp / starnameds )? '}'
dictitem <- '**' operand binop* / expr ':' expr
comp <- ( 'async'? 'for' targets 'in' disj ( 'if' disjn )* )+
disjn <- name ':=' disj / disj
args <- named comp ( &')' ) / pos ( ',' pos )* ( ',' kw )* ( ',' kw2 )* ','? / kw ( ',' kw )* ( ',' kw2 )* ','? / kw2 ( ',' kw2 )* ','?
pos <- '*' expr / name ':=' expr / !( name '=' ) expr !{ '=' 'for' ':=' }
kw <- name '=' expr !'for' / '*' expr
kw2 <- '**' expr / name '=' expr
name <- { 'N' 'match' 'case' 'type' }
field <- ( yield / stars ) '='? '$'
"""

#: Symbols: S statement, I if, L elif, E else, T try, X except, Y except*, F finally, R loop, W with,
#: D def or class, M match, C case, @ decorator; in lower case with the body on the same line. > and < are
#: indent and dedent.
BLOCK = r"""
module <- stmt* '$'
block <- '>' stmt+ '<'
stmt <- 'S' / if / loop / try / 'W' block / 'w' / '@'* ( 'D' block / 'd' ) / 'M' '>' ( 'C' block / 'c' )+ '<'
if <- ( 'I' block / 'i' ) ( 'L' block / 'l' )* else?
else <- 'E' block / 'e'
loop <- ( 'R' block / 'r' ) else?
try <- ( 'T' block / 't' ) ( ( 'X' block / 'x' )+ else? final? / ( 'Y' block / 'y' )+ else? final? / final )
final <- 'F' block / 'f'
"""

_LINE, _FIELD, _BLOCK = Peg(LINE, "line"), Peg(LINE, "field"), Peg(BLOCK, "module")
_KIND = {"if": "I", "elif": "L", "else": "E", "while": "R", "for": "R", "try": "T", "finally": "F", "with": "W", "def": "D", "class": "D", "@": "@"}

_PREFIX = r"(?<!\w)(?:[fFtT][rR]?|[rR][fFbBtT]?|[bB][rR]?|[uU])"
_LEX = re.compile(
    r"#[^\n]*|\\\n"
    r"|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*(?:\"\"\"|\\?\Z)|'''(?:[^\\']|\\.|'(?!''))*(?:'''|\\?\Z)"
    r"|\"(?:[^\\\"\n]|\\.)*\"|'(?:[^\\'\n]|\\.)*'",
    re.S,
)
_BEFORE = re.compile(_PREFIX + r"\Z")
_PREFIXED = re.compile(_PREFIX + "(?=[\x02\x03])")
_CLOSE = {'"""': re.compile(r"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"", re.S), "'''": re.compile(r"(?:[^\\']|\\.|'(?!''))*'''", re.S)}
_NUM = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
    r"|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|(?:0(?:_?0)*|[1-9](?:_?\d)*)(?!\.[^\W\d]))(?![\w])"
)
_DOT_EXP = re.compile(r"(?<![\w.])\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])(?!\w)")
_NAME = re.compile(r"\b(?!(?:" + "|".join(KEYWORDS + SOFT) + r")\b)[^\W\d]\w*")
_TOK = re.compile(r"[\x02\x03]|[^\W\d]\w*|0(?![\w])|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^<>=!]=|\*\*|//|<<|>>|[-+*/%@&|^~<>=.,:;()\[\]{}]|\S")
#: The operators and marks of the language.
_MARKS = frozenset("+ - * / // % @ & | ^ ~ << >> ** = += -= *= /= //= %= @= &= |= ^= >>= <<= **= -> := == != < > <= >= . , : ; ( ) [ ] { } ... 0 N".split()) | set(KEYWORDS) | set(SOFT)
#: At most so many different logical lines are remembered by a worker.
LINE_MEMO = 200_000
_lines: dict[str, tuple] = {}
_fields: dict[str, bool] = {}
_raws: dict[str, _Lexed] = {}
_blocks: dict[str, tuple] = {}


_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?:\{([^{}]*)\})?|[\s\S])")


def _bad_text(body: str, _raw: bool) -> bool:
    """Whether a text has an escape that stands for nothing."""
    if "\\" not in body:
        return False
    for m in _ESCAPES.finditer(body):
        c = m.group()[1]
        if c in "xuU" and len(m.group()) == 2:
            if m.group() in ("\\x", "\\u", "\\U") and not _ESCAPED[c].match(body, m.end()):
                return True
        elif c == "N":
            try:
                unicodedata.lookup(m[1] or "")
            except KeyError:
                return True
    return False


_ESCAPED = {"x": re.compile("[0-9a-fA-F]{2}"), "u": re.compile("[0-9a-fA-F]{4}"), "U": re.compile("000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4}")}
_BYTES = re.compile(r"\\(?:x(?:[0-9a-fA-F]{2})?|[\s\S])")


def _bad_bytes(body: str, raw: bool) -> bool:
    return not body.isascii() or (not raw and any(m.group() == "\\x" for m in _BYTES.finditer(body)))


_BAD = {"": _bad_text, "b": _bad_bytes, "r": None}


class _Lexed:
    """What the lexical pass leaves of one physical line (more where a backslash joins them)."""

    __slots__ = ("check", "formatted", "norm", "open", "rest")

    def __init__(self, line: str):
        self.open, self.rest, self.formatted, self.check = "", "", False, None
        found = False

        def put(m: re.Match) -> str:
            nonlocal found
            body = m.group()
            c = body[0]
            if c == "#":
                return ""
            if c == "\\":
                return " "
            before = _BEFORE.search(m.string[max(0, m.start() - 3) : m.start()])
            found = found or before is not None
            kind = before.group().lower() if before else ""
            formatted = "f" in kind or "t" in kind
            check = _BAD["b" if "b" in kind else "r" if "r" in kind else ""]
            q = 3 if body[:3] in _CLOSE else 1
            if q == 3 and not _CLOSE[body[:3]].fullmatch(body[3:]):
                self.open, self.rest, self.formatted, self.check = body[:3], body[3:], formatted, check
            elif formatted and ("{" in body or "}" in body) and not _fstring(body[q:-q], "r" in kind):
                return "?"
            if check is not None and check(body, "r" in kind):
                return "?"
            return "\x03" if "b" in kind else "\x02"

        norm = _LEX.sub(put, line)
        if found:
            norm = _PREFIXED.sub("", norm)
        if ".e" in norm or ".E" in norm or ".j" in norm or ".J" in norm:
            norm = _DOT_EXP.sub("0", norm)
        self.norm = _NUM.sub("0", _NAME.sub("N", norm)).strip(" \t\f")


def _fstring(body: str, raw: bool, depth: int = 0) -> bool:
    """Whether the replacement fields of a formatted string parse."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\" and not raw and body.startswith("\\N{", i):
            i = body.find("}", i) + 1
            if not i:
                return False
            continue
        if c == "{":
            if body.startswith("{{", i) and not depth:
                i += 2
                continue
            j, stack, quote = i + 1, [], ""
            while j < n:
                d = body[j]
                if quote:
                    if d == quote:
                        quote = ""
                elif d in "\"'":
                    quote = d
                elif d in "([{":
                    stack.append(d)
                elif d in ")]}":
                    if not stack:
                        break
                    stack.pop()
                elif not stack and (d == ":" or d == "!" and body[j + 1 : j + 2] != "="):
                    break
                j += 1
            if j >= n or body[j] in ")]":
                return False
            if not _field(body[i + 1 : j]):
                return False
            if body[j] == "!":
                m = re.match(r"!\s*[sra]\s*(?=[:}])", body[j:])
                if not m:
                    return False
                j += m.end()
            if body[j] == ":":
                k, level = j + 1, 0
                while k < n and (level or body[k] != "}"):
                    level += {"{": 1, "}": -1}.get(body[k], 0)
                    k += 1
                if k >= n or not _fstring(body[j + 1 : k], raw, depth + 1):
                    return False
                j = k
            i = j + 1
            continue
        if c == "}":
            if body.startswith("}}", i) and not depth:
                i += 2
                continue
            return False
        i += 1
    return True


def _field(source: str) -> bool:
    known = _fields.get(source)
    if known is None:
        toks = [t for t in _tokens(_normal(source).replace("\n", " "))]
        known = _FIELD.match([*toks, "$"])[0]
        if len(_fields) < LINE_MEMO:
            _fields[source] = known
    return known


def _normal(text: str) -> str:
    return _Lexed(text).norm


def _tokens(line: str) -> list[str]:
    return [t if t in _MARKS else "S" if t == "\x02" else "B" if t == "\x03" else "?" for t in _TOK.findall(line)]


def _line(line: str, whole: bool = False) -> tuple[int, str, int, int]:
    """(brackets left open, kind of the line or '' if it doesn't parse, furthest token, number of tokens)."""
    toks = _tokens(line)
    opened = _opened(line)
    if opened > 0 and not whole:
        return opened, "", 0, len(toks)
    ok, far = _LINE.match([*toks, "$"])
    if not ok:
        return 0, "", far, len(toks)
    first = toks[0]
    if first == "async" and len(toks) > 1:
        first = toks[1]
    if first == "except":
        kind = "Y" if toks[1] == "*" else "X"
    elif first in ("match", "case"):
        kind = {"match": "M", "case": "C"}[first] if toks[-1] == ":" or (first == "case" and ":" in toks and not _LINE.match([*toks, "$"], start="simples")[0]) else "S"
        if first == "case" and kind == "S" and _LINE._run([*toks, "$"], None, "simples")[0] < len(toks):
            kind = "c"
        return 0, kind if kind != "C" or toks[-1] == ":" else "c", 0, len(toks)
    else:
        kind = _KIND.get(first, "S")
    if kind not in "S@" and toks[-1] != ":":
        kind = kind.lower()
    return 0, kind, 0, len(toks)


def _opened(line: str) -> int:
    return line.count("(") + line.count("[") + line.count("{") - line.count(")") - line.count("]") - line.count("}")


def _known(line: str, whole: bool = False) -> tuple:
    info = _lines.get(line)
    if info is None:
        info = _line(line, whole)
        if len(_lines) < LINE_MEMO:
            _lines[line] = info
    return info


_STRING = re.compile(r"(?<!\w)([fFtT][rR]?|[rR][fFtT]|[rR]?[bB]?|[bB][rR]?|[uU])(\"\"\"|'''|\"|')|#[^\n]*|[({\[]|[)}\]]|:|!(?!=)|\n")


def _unnested(text: str) -> str:
    """The text with plain names in place of the strings that stand in fields of formatted strings, and without
    line breaks there: such fields may use the quotes of the string around them."""
    out: list[str] = []
    done = 0
    # levels: ("f", quote) in the text of a formatted string, ("{", brackets) in one of its fields
    levels: list[list] = []
    i, n = 0, len(text)
    while i < n:
        if levels and levels[-1][0] == "f":
            quote, raw = levels[-1][1], levels[-1][2]
            c = text[i]
            if c == "\\" and not raw:
                i += 2
            elif quote and text.startswith(quote, i):
                i += len(quote)
                levels.pop()
                if levels:  # a formatted string within a field
                    done = i
                    out.append("N")
            elif not quote and c == "}":  # the end of a format
                levels.pop()
                levels.pop()
                i += 1
            elif c == "{" and not (quote and text.startswith("{{", i)):
                levels.append(["{", 0])
                i += 1
            elif quote and c == "{":
                i += 2
            elif c == "\n" and len(quote) == 1:
                return text  # never closed
            else:
                i += 1
            continue
        m = _STRING.search(text, i)
        if not m:
            break
        inside = bool(levels)
        t = m.group()
        i = m.end()
        if m[2]:
            if not {*m[1].lower()}.isdisjoint("ft"):
                if inside:
                    out.append(text[done : m.start()] if not any(l[0] == "f" and l[3] for l in levels[:-1]) else "")
                levels.append(["f", m[2], "r" in m[1].lower(), inside])
                continue
            end = i
            while end < n and not text.startswith(m[2], end):
                end += 2 if text[end] == "\\" else 1
            i = end + len(m[2])
            if inside:
                if not any(l[0] == "f" and l[3] for l in levels[:-1]):
                    out.append(text[done : m.start()] + "N")
                done = i
        elif inside and t[0] in "({[":
            levels[-1][1] += 1
        elif inside and t[0] in ")}]":
            if levels[-1][1]:
                levels[-1][1] -= 1
            elif t == "}":
                levels.pop()
            else:
                return text
        elif inside and t == ":" and not levels[-1][1]:
            levels.append(["f", "", levels[-2][2], levels[-2][3]])
        elif inside and t == "\n":
            out.append(text[done : m.start()] + " ")
            done = i
    return "".join(out) + text[done:]


_NESTS = re.compile(r"(?<!\w)(?:[fFtT][rR]?|[rR][fFtT])[\"']")


def parse(text: str) -> tuple[bool, int, str]:
    """As :func:`_parse`, and where that fails, once more without strings nested in formatted strings."""
    got = _parse(text)
    if not got[0] and _NESTS.search(text):
        flat = _unnested(text)
        if flat != text and _parse(flat)[0]:
            return True, 0, ""
    return got


def _parse(text: str) -> tuple[bool, int, str]:
    """(whether all input is consumed, number of tokens before the furthest failure, what was missing).

    The count of tokens is -1 where the failure stands at the end of the input.
    """
    if "\0" in text:
        return False, 0, "null byte"
    if text.startswith("﻿"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    kinds: list[str] = []
    starts = [0]  # where a statement at the left margin begins in kinds
    indents, alts = [0], [0]  # with tabs of eight and of one column: both must agree
    opened = 0
    seen = 0  # tokens before this line
    before: list[int] = []  # tokens before each symbol of kinds
    parts: list[str] = []
    known, memo, raws, head = _known, _lines, _raws, ""
    check, check_raw = None, False
    quote, formatted, held = "", False, ""  # inside a string of several lines: its quotes, its text so far
    rows = iter(text.split("\n"))
    for raw in rows:
        if quote:
            if quote not in raw or (close := _CLOSE[quote].match(raw)) is None:
                if formatted:
                    held += "\n" + raw
                if check is not None and check(raw, check_raw):
                    head += "?"
                continue
            if check is not None and check(raw[: close.end()], check_raw):
                head += "?"
            if formatted and not _fstring(held + "\n" + raw[: close.end() - 3], False):
                head += "?"
            lexed = _Lexed(raw[close.end() :])
            body = head + lexed.norm
        else:
            body = raw.strip(" \t\f")
            if not body:
                continue
            lexed = raws.get(body)
            if lexed is None:
                lexed = _Lexed(body)
                if len(raws) < LINE_MEMO:
                    raws[body] = lexed
            if not parts:
                margin = raw[: len(raw) - len(raw.lstrip(" \t\f"))]
            body = lexed.norm
        if raw.endswith("\\") and not lexed.open and (body.endswith("\\") or '"' in body or "'" in body):
            whole = raw[close.end() :] if quote else raw
            while whole.endswith("\\") and (more := next(rows, None)) is not None:
                whole += "\n" + more
            lexed = _Lexed(whole.lstrip(" \t\f"))
            body = (head if quote else "") + lexed.norm
        quote = lexed.open
        if quote:
            formatted, held, head, check, check_raw = lexed.formatted, lexed.rest, body, lexed.check, False
            continue
        if not body:
            continue
        if parts:
            parts.append(body)
            opened += _opened(body)
            if opened > 0:
                continue
            line = " ".join(parts)
            parts = []
            info = memo.get(line) or known(line, True)
        else:
            info = memo.get(body) or known(body)
            if info[0] > 0:
                opened = info[0]
                parts.append(body)
                continue
        if not info[1]:
            return False, seen + info[2], "token"
        col = alt = len(margin)
        if "\t" in margin or "\f" in margin:
            margin = margin.rpartition("\f")[2]
            col, alt = len(margin.expandtabs(8)), len(margin)
        if col != indents[-1] or alt != alts[-1]:
            if col > indents[-1] and alt > alts[-1]:
                indents.append(col)
                alts.append(alt)
                kinds.append(">")
                before.append(seen)
            else:
                while col < indents[-1]:
                    indents.pop()
                    alts.pop()
                    kinds.append("<")
                    before.append(seen)
                if col != indents[-1] or alt != alts[-1]:
                    return False, seen, "indentation"
        if not col and info[1] not in "LlEeXxYyFf" and (not kinds or kinds[-1] != "@"):
            starts.append(len(kinds))
        if info[1] != "S" or not kinds or kinds[-1] != "S" or starts[-1] == len(kinds):
            kinds.append(info[1])  # a run of simple statements is one symbol
            before.append(seen)
        seen += info[3]
    if parts or quote:
        return False, -1, "closing bracket"
    kinds += ["<"] * (len(indents) - 1)
    starts.append(len(kinds))
    for a, b in zip(starts, starts[1:]):
        if a == b:
            continue
        key = "".join(kinds[a:b])
        if key == "S":
            continue
        got = _blocks.get(key)
        if got is None:
            got = _BLOCK.match([*kinds[a:b], "$"])
            if len(_blocks) < LINE_MEMO:
                _blocks[key] = got
        if not got[0]:
            at = a + got[1]
            return False, before[at] if at < len(before) else -1, "block"
    return True, 0, ""


#: The original's tokens, to turn a count of tokens into a position.
SPANS = re.compile(
    r"#[^\n]*|\\\n|" + _PREFIX + r"?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\\\"\n]|\\.)*\"|'(?:[^\\'\n]|\\.)*')|"
    + _NUM.pattern
    + r"|[^\W\d]\w*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^<>=!]=|\*\*|//|<<|>>|[-+*/%@&|^~<>=.,:;()\[\]{}]|\S",
    re.S,
)


def position(text: str, count: int) -> int:
    """The code-point offset of the token after ``count`` tokens."""
    if count < 0:
        return len(text.rstrip())
    n = 0
    for m in SPANS.finditer(text):
        if m.group()[0] == "#" or m.group() == "\\\n":
            continue
        if n == count:
            return m.start()
        n += 1
    return len(text.rstrip())
