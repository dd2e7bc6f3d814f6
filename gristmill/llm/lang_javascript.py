"""JavaScript: a lexical pass that tells division from regular expressions, and a grammar.

Files are read as scripts or modules alike. Statements at the left margin that begin where nothing before
can go on are parsed one by one; their results are kept by content and shared by all files of a worker.
"""

from __future__ import annotations

import re

from .peg import Peg

#: The reserved words of ECMAScript.
RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function "
    "if import in instanceof new null return super switch this throw true try typeof var void while with"
).split()
#: Words that the grammar asks for in places, names elsewhere.
SOFT = "let static async await yield of get set as from".split()

JS = r"""
file <- item* '$'
item <- import / export / statement
import <- 'import' !{ '(' '.' } ( 'S' / importclause 'from' 'S' ) ( 'with' object )? end
importclause <- word ( ',' ( namespace / named ) )? / namespace / named
namespace <- '*' 'as' word
named <- '{' ( spec ( ',' spec )* ','? )? '}'
spec <- ( prop / 'S' ) ( 'as' ( prop / 'S' ) )?
export <- 'export' ( 'default' ( function / class / assign end ) / '*' ( 'as' ( prop / 'S' ) )? 'from' 'S' end / named ( 'from' 'S' )? end / declaration )
declaration <- function / class / var
statement <= block / var / function / class / ';' / if / for / while / do / 'return' ( !@nl expr )? end / 'break' ( !@nl name )? end / 'continue' ( !@nl name )? end / 'throw' !@nl expr end / try / switch / 'debugger' end / 'with' '(' expr ')' sub / name ':' sub / !{ 'function' 'class' '{' } expr end
sub <- !{ 'const' 'class' } !( 'let' { 'N' '{' '[' } ) statement
block <- '{' statement* '}'
end <- ';' / &'}' / &'$' / @nl
var <- 'var' bindings end / 'const' fixed ( ',' fixed )* end / 'let' &{ 'N' '{' '[' 'async' 'await' 'yield' 'of' 'get' 'set' 'as' 'from' 'static' } bindings end
bindings <- binding ( ',' binding )*
binding <- name ( '=' assign )? / bindtarget '=' assign
fixed <- bindtarget '=' assign
bindtarget <= name / '{' ( bindprop ( ',' bindprop )* ','? )? '}' / '[' ( bindelem? ',' )* bindelem? ']'
bindprop <- '...' bindtarget / propname ':' bindtarget ( '=' assign )? / name ( '=' assign )?
bindelem <- '...' bindtarget / bindtarget ( '=' assign )?
function <- ( 'async' !@nl )? 'function' '*'? name params body
params <= '(' ( bindelem ( ',' bindelem )* ','? )? ')'
body <= '{' statement* '}'
class <- 'class' name classtail
classtail <- ( 'extends' lhs )? '{' member* '}'
member <- ';' / 'static' body / ( 'static' &{ 'N' 'S' '0' '[' '#N' '*' 'async' 'get' 'set' 'K' 'await' 'yield' 'of' 'as' 'from' 'let' 'static' } )? ( method / field )
method <= { 'get' 'set' } propname params body / ( 'async' !@nl )? '*'? propname params body
field <- propname ( '=' assign )? end
if <- 'if' '(' expr ')' sub ( 'else' sub )?
for <- 'for' 'await'? '(' ( { 'var' 'const' 'let' } bindtarget { 'of' 'in' } expr / ( { 'var' 'let' } bindings / 'const' fixed ( ',' fixed )* / expr )? ';' expr? ';' expr? / ptarget { 'of' 'in' } expr ) ')' sub
while <- 'while' '(' expr ')' sub
do <- 'do' sub 'while' '(' expr ')' ';'?
try <- 'try' block ( catch final? / final )
catch <- 'catch' ( '(' bindtarget ')' )? block
final <- 'finally' block
switch <- 'switch' '(' expr ')' '{' ( 'case' expr ':' statement* / 'default' ':' statement* )* '}'
expr <- assign ( ',' assign )*
assign <= arrow / pattern '=' assign / target { '=' '+=' '-=' '*=' '/=' '%=' '**=' '<<=' '>>=' '>>>=' '&=' '|=' '^=' '&&=' '||=' '??=' } assign / 'yield' ( !@nl '*'? assign )? / cond
arrow <- ( 'async' !@nl )? ( name / params ) !@nl '=>' ( body / !'{' assign )
cond <- short ( '?' assign ':' assign )?
short <- binary ( ( '??' binary )+ / ( { '||' '&&' } binary )* )
binary <- unary ( { '|' '^' '&' '==' '!=' '===' '!==' '<' '>' '<=' '>=' 'instanceof' 'in' '<<' '>>' '>>>' '+' '-' '*' '/' '%' '**' } unary )*
unary <- { 'delete' 'void' 'typeof' '+' '-' '~' '!' 'await' } unary !'**' / { '++' '--' } target / target !@nl { '++' '--' } / lhs
pattern <= '[' ( pelem? ',' )* pelem? ']' / '{' ( pprop ( ',' pprop )* ','? )? '}'
pelem <- '...' ptarget / ptarget ( '=' assign )?
pprop <- '...' target / propname ':' ptarget ( '=' assign )? / name ( '=' assign )?
ptarget <= pattern !{ '.' '?.' '[' '(' 'T' } / target
target <= tchain / name !{ '.' '?.' '[' '(' 'T' '=>' } / '(' target ')' !{ '.' '?.' '[' '(' 'T' '=>' }
tchain <- tbase ( ntail &tail )* ( '.' ( prop / '#N' ) / '[' expr ']' ) !tail
tbase <- 'new' '.' 'target' / 'new' lhsnew args? / primary
ntail <- '.' ( prop / '#N' ) / '[' expr ']' / args / 'T'
lhs <= ( 'new' '.' 'target' / 'new' lhsnew ( args )? / primary ) tail*
lhsnew <- 'new' lhsnew args? / primary ( '.' ( prop / '#N' ) / '[' expr ']' )*
tail <- '.' ( prop / '#N' ) / '?.' ( args / '[' expr ']' / prop / '#N' ) / '[' expr ']' / args / 'T'
args <- '(' ( arg ( ',' arg )* ','? )? ')'
arg <- '...' assign / assign
primary <= { '0' 'S' 'T' 'R' 'this' 'null' 'true' 'false' 'super' } / ( 'async' !@nl )? 'function' '*'? name? params body / 'class' ( name classtail / classtail ) / 'import' ( '.' ( prop ) / args ) / name / '[' ( arg? ',' )* arg? ']' / object / '(' expr ')' / '#N' &'in'
object <= '{' ( objprop ( ',' objprop )* ','? )? '}'
objprop <- '...' assign / method / propname ':' assign / name
propname <- prop / 'S' / '0' / '#N' / '[' assign ']'
prop <- { 'N' 'target' KEYS }
word <- name
name <- { 'N' 'target' 'let' 'static' 'async' 'await' 'yield' 'of' 'get' 'set' 'as' 'from' }
"""
_JS = Peg(JS.replace("KEYS", " ".join(f"'{w}'" for w in RESERVED + SOFT)), "file")
_TOK = re.compile(
    r"(?P<sp>[^\S\n\r\u2028\u2029]+|//[^\n\r]*|<!--[^\n\r]*|\ufeff)|(?P<nl>[\n\r\u2028\u2029]|/\*(?:[^*]|\*(?!/))*\*/)"
    r"|(?P<name>#?(?:[^\W\d]|\$|\\u[0-9a-fA-F{])(?:\w|\$|\\u\{?[0-9a-fA-F]+\}?|\u200c|\u200d)*)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|0\d+|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)n?(?![\w$]))"
    r"|(?P<op>\.\.\.|=>|>>>=|\*\*=|<<=|>>=|>>>|===|!==|&&=|\|\|=|\?\?=|\?\.(?!\d)|\*\*|\+\+|--|<<|>>|&&|\|\||\?\?|[-+*%&|^<>=!]=|[-+*%&|^~<>=!?:;,.(){}\[\]@])"
    r"|(?P<slash>/=?)|(?P<tick>`)|(?P<bad>[\s\S])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_WORDS = frozenset(RESERVED + SOFT)
#: After these a slash divides; after any other token it begins a regular expression (brackets: see ``_Brackets``).
_VALUE = frozenset(["N", "#N", "0", "S", "T", "R", "]", "this", "null", "true", "false", "super", *SOFT])
_HEADS = frozenset("if while for with".split())
#: A brace after these opens a block, or a body that no operator follows.
_BLOCK_AFTER = frozenset(["", ";", "{block", "}block", "else", "do", "try", "finally", "=>", "static"])
_BAD_ESCAPE = re.compile(r"\\(?:[^xu]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|(\\)", re.S)


class _Brackets:
    """What the open brackets are, so that a slash behind a closing one is told apart."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.last = ""  # the last token, braces with their kind
        self.value = False  # whether the last token ends a value
        self.words: list[str] = []  # function and class words whose body is still to come: "block" or "value"

    def _at_statement(self) -> bool:
        return self.last in _BLOCK_AFTER or self.last in (")head", ":label")

    def take(self, t: str) -> None:
        last = self.last
        if t in ("(", "["):
            kind = "head" if last in _HEADS or (last == "await" and False) else "body" if last in ("function", "function*") or last == "Nfunction" else ""
            self.stack.append((t, kind))
            self.last, self.value = t, False
        elif t == "{":
            if last == ")body" or (self.words and last in ("Nclass", "class", "Nextends")):
                kind = self.words.pop() if self.words else "block"
            elif last in (")head", ")catch", "catch", "=>") or self._at_statement() or last == ")" or last == "Nlabel":
                kind = "block"
            else:
                kind = "value"
            self.stack.append((t, kind))
            self.last, self.value = "{block" if kind == "block" else "{", False
        elif t in (")", "]", "}"):
            kind = self.stack.pop()[1] if self.stack else ""
            if t == ")":
                self.last, self.value = ")" + kind, kind != "head"
            elif t == "}":
                self.last, self.value = "}" + kind, kind == "value"
            else:
                self.last, self.value = t, True
        else:
            if t in ("function", "class"):
                statement = self._at_statement() or last in ("export", "default") or last == "async" and False
                self.words.append("block" if statement else "value")
                self.last = t
            elif last in ("function", "function*") and t == "*":
                self.last = "function*"
            elif t == "N" and last in ("function", "function*"):
                self.last = "Nfunction"
            elif t == "N" and last == "class":
                self.last = "Nclass"
            elif self.words and last in ("Nclass", "class", "Nextends") or t == "extends":
                self.last = "Nextends"
            elif t == ":" and last in ("N",) and False:
                self.last = ":label"
            else:
                self.last = t
            self.value = t in _VALUE or t in ("++", "--") and self.value


def regex_ok(source: str) -> bool:
    """Whether ``/body/flags`` is a regular expression: its groups, classes, repeats and flags."""
    body, _, flags = source[1:].rpartition("/")
    if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy") or {"u", "v"} <= set(flags):
        return False
    strict = "u" in flags or "v" in flags
    depth, atom, i, n = 0, False, 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\":
            i, atom = i + 2, True
            continue
        if c == "[":
            i += 1
            level = 1
            while i < n and level:
                if body[i] == "\\":
                    i += 1
                elif body[i] == "[" and "v" in flags:
                    level += 1
                elif body[i] == "]":
                    level -= 1
                elif body[i] == "-" and i > 1 and i + 1 < n and "v" not in flags:
                    lo, hi = body[i - 1], body[i + 1]
                    if lo.isalnum() and hi.isalnum() and body[i - 2] != "\\" and body[i - 2] != "-" and lo > hi:
                        return False
                i += 1
            if level:
                return False
            atom = True
            continue
        if c == "(":
            depth += 1
            m = _GROUP.match(body, i)
            if body.startswith("(?", i) and not m:
                return False
            i, atom = m.end() if m else i + 1, False
            continue
        if c == ")":
            depth -= 1
            if depth < 0:
                return False
            atom = True
        elif c in "*+?":
            if not atom:
                return False
            i += body.startswith("?", i + 1)
            atom = False
        elif c == "{" and (m := _TIMES.match(body, i)):
            if not atom or m[2] and int(m[2]) < int(m[1]):
                return False
            i, atom = m.end() + body.startswith("?", m.end()), False
            continue
        elif c in "{}]" and strict:
            return False
        else:
            atom = c not in "|^$"
        i += 1
    return depth == 0


_GROUP = re.compile(r"\(\?(?::|=|!|<=|<!|<[^\W\d][\w$]*>|<[$][\w$]*>|[ims]*(?:-[ims]+)?:)")
_TIMES = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_STARTS = frozenset("function async const let var class if for return switch throw try import export N".split())
#: At most so many statements are remembered by a worker.
CHUNK_MEMO = 100_000
_chunks: dict[tuple, tuple] = {}


def _lex(text: str, pos: int, toks: list, nls: list, at: list, inner: bool) -> int:
    """Read tokens from ``pos``; in a template's field, up to its closing brace. -1: the text ends too soon."""
    nl, depth, n = False, 0, len(text)
    brackets = _Brackets()
    match = _TOK.match
    while pos < n:
        m = match(text, pos)
        kind = m.lastgroup
        start, pos = pos, m.end()
        if kind == "sp":
            continue
        if kind == "nl":
            nl = nl or text[start] != "/" or "\n" in m.group()
            continue
        if kind == "name":
            t = m.group()
            if t[0] == "#":
                t = "#N"
            elif t == "target" and toks[-2:] == ["new", "."]:
                pass
            elif t not in _WORDS or (toks and toks[-1] in (".", "?.")):
                t = "N"
        elif kind == "op":
            t = m.group()
            if t == "--" and (nl or not toks) and text.startswith("-->", start):  # a comment in the form of old pages
                pos = re.compile(r"[^\n\r]*").match(text, start).end()
                continue
            if inner and t in "{}":
                if t == "}" and not depth:
                    return pos
                depth += 1 if t == "{" else -1
        elif kind == "str":
            t = "S" if "\\" not in m.group() or not any(e[1] for e in _BAD_ESCAPE.finditer(m.group())) else "?"
        elif kind == "num":
            t = "0"
        elif kind == "slash":
            t = m.group()
            if not brackets.value:
                r = _REGEX.match(text, start)
                t, pos = ("R" if regex_ok(r.group()) else "?", r.end()) if r else ("?", pos)
        elif kind == "tick":
            t = "T"
            while True:
                pos = _TEXT.match(text, pos).end()
                if pos >= n:
                    return -1
                if text[pos] == "`":
                    pos += 1
                    break
                ft, fn, fa = [], [], []
                pos = _lex(text, pos + 2, ft, fn, fa, True)
                if pos < 0:
                    return -1
                if not _JS.match(["(", *ft, ")", "$"], [False, *fn, False, False])[0]:
                    t = "?"
        elif start == 0 and text.startswith("#!"):
            pos = text.find("\n") if "\n" in text else n
            continue
        else:
            t = "?"
        brackets.take(t)
        toks.append(t)
        nls.append(nl)
        at.append(start)
        nl = False
    return -1 if inner else pos


def parse(text: str) -> tuple[bool, int, str]:
    """(parses, code-point offset of the furthest failure or -1 for the end, what was missing)."""
    toks: list[str] = []
    nls: list[bool] = []
    at: list[int] = []
    if _lex(text, 0, toks, nls, at, False) < 0:
        return False, -1, "closing mark"
    cuts, depth, last = [0], 0, ""
    for i, t in enumerate(toks):
        if not depth and nls[i] and last in ("}", ";") and t in _STARTS:
            cuts.append(i)
        if t in ("{", "(", "["):
            depth += 1
        elif t in ("}", ")", "]"):
            depth -= 1
        last = t
    cuts.append(len(toks))
    for a, b in zip(cuts, cuts[1:]):
        key = (*toks[a:b], *nls[a:b])
        got = _chunks.get(key)
        if got is None:
            got = _JS.match([*toks[a:b], "$"], [*nls[a:b], True])
            if len(_chunks) < CHUNK_MEMO:
                _chunks[key] = got
        if not got[0]:
            far = a + got[1]
            return False, at[far] if far < len(at) else -1, "token"
    return True, 0, ""
