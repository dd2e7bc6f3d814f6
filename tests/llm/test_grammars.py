"""Grammars against exact parsers and literal programs."""

import ast
import glob
import os
import random
import tomllib
import warnings

import pytest

from gristmill.llm import lang_data, lang_javascript, lang_python

JS_VALID = [
    'if (x) /re/.test(y);',
    'while (a) /b/.exec(c)',
    'function f(){}\n/re/.test(x)',
    '<!-- a\nx=1\n--> b',
    'a = b / c / d',
    'a = (b) / c',
    'x = {}\n/1',
    'x = {a:1} / 2',
    'var f = function(){} / 2',
    'for(;;) /a/.x',
    'const {a, b} = c',
    'for (const x of y) {}',
    'for (const [a,b] of y) z()',
    '[a, b] = [b, a]',
    '({a, b: c.d, ...r} = e)',
    'a.b = 1',
    'a[b] = c',
    '(a) = 1',
    'a?.b',
    'a ?? b',
    '(a ?? b) || c',
    'a || b && c',
    '(-1) ** 2',
    '2 ** -1',
    '++a.b',
    'a++ ** 2',
    'if (a) { let x }',
    'new.target',
    'function F(){ return new.target }',
    'import.meta.url',
    'x = /[(]/',
    '/a{2,3}?(?<n>b)\\k<n>/u',
    'let x, y = 1',
    'for (a in b) c',
    'for (a.b of c) d',
    'for ([a,b] of c) d',
    'async () => { await x }',
    'x => ({a})',
    '({a}) => a',
    '({a = 1}) => a',
    '[a = 1] = b',
    '({a = 1} = b)',
    '({ a: [b] = [] } = c)',
    'let async',
    'label: for(;;) break label',
    'a\n++b',
    'x = a ? /b/ : /c/',
    'return',
    'class A extends B { static { x } #p = 1; get x() { return this.#p } }',
    'x = class {} / 2',
    '`${a}/${b}`',
    'x = `a${/}/.test(b)}c`',
    '(a, b) => a / b',
    'a = b ? (c) / d : e',
    'switch(a){case /x/: b}',
    'var o = {f() {} , /*c*/ g: 1}',
    'yield = 1',
    'a = {} / 1',
    'if (a) {} /re/.test(b)',
    '({}) / 1',
    'f(function(){}) / 2',
    '!function(){}()',
    '(function(){})() / 2',
    'do x(); while (y) /re/.exec(z)',
    'export default function(){}\n/re/.x',
    'export default class {}\n/re/.x',
    'let = 1',
    'for (let i = 0, n = 1; i < n; i++);',
    'for (var i in {}) ;',
    'a ** 2',
    'f(...a, b)',
    'a = async function*(){}',
    "x = {async *a(){}, get [b](){}, 'c': 1, 2: 3, set d(e){}}",
    'try {} catch {}',
    'if (a) function f(){}',
    'a?.[0]?.(b)',
    'a = b\n/c/g',
    'a.if / 2',
    'a.b++ / 2',
    'x = {a: function(){} / 2}',
    '(a=>{})\n/x/g',
    'x = y => {}\n/re/.test(z)',
    "import a, {b as c} from 'd'; export {c as default}",
    "import('x').then(y)",
    "'\\u{1F600}\\x41'",
    'for await (const x of y) z',
    'var x = function a() {}, y = 1',
]
JS_INVALID = [
    'const x;',
    '1 = 2',
    '1++',
    '({a=1})',
    'a?.b = 1',
    'a ?? b || c',
    '-1 ** 2',
    'if (a) let x',
    '/(/',
    'new.foo',
    'enum = 1',
    'let {a};',
    '++1',
    'a + b = 1',
    'for (1 of x);',
    "'\\x1'",
    '/a/gg',
    '/[b-a]/',
    '/a**/',
    '/?a/',
    "'\\u{110000000}'",
    'let x = ;',
    'x = {a:1',
    'a b',
    'if (a',
    'for (const x;;) {}',
    'a || b ?? c',
    'while (a) const x = 1',
    'class { }',
    'function () {}',
    'var 1a',
    'x = (a, )',
    '[a+b] = c',
    '({a:1} = b)',
    'this = 1',
    'import a from b',
    '/{1}/u',
]
PYTHON = [
    "x='abc' b'x'",
    "x=b'é'",
    "x='\\x1'",
    "x='\\N{foo}'",
    "x='\\N{DASH}'",
    "x='\\N{EM DASH}'",
    "x=b'\\x1'",
    "x=r'\\x1'",
    'x={**a for a in b}',
    'def f(a,/,b,/):pass',
    'def f(a,/,b=1):pass',
    'def f(a,b=1,/,c=2,*,d):pass',
    '1.real',
    '1 .real',
    '1..real',
    '0x1.real',
    'x=1.e5',
    'x=1.j',
    'x=1_0.imag',
    "match x:\n  case {'a':1,**r}: pass",
    "match x:\n  case {**r,'a':1}: pass",
    "match x:\n  case 'a' b'c': pass",
    "x=f'{a['b']}'",
    "x=f'{f'{1}'}'",
    'x=f"{\', \'.join("abc")}"',
    "x=f'{a['b']!r:>{w['x']}}'",
    "x=f'{a\n+b}'",
    "x=f'{a['b'}'",
    "x=f'''{a['''b''']}'''",
    "x=f'{a['b']:{f'{c}'}}' + 'y'",
    "x='''a\\x1\n'''",
    "x='''a\n\\N{foo}'''",
    "x=f'{{}}'",
    "x=f'{a!x}'",
    "x=rf'\\{a['b']}'",
    "x=b'''a\né'''",
    "y='a' 'b' f'{c}'",
    "x=f'{x:{y}}{z['q']}'",
    "x=u'a' b'b'",
    'lambda a,/,b,/:1',
    "x=f'{lambda x: 1}'",
    "x=f'{(lambda x: 1)}'",
    "x='\\u12'",
    "x='\\\\x1'",
    "x='\\\nabc'",
]
TOML = [
    'a=1\na=2',
    '[a]\n[a]',
    '[[a]]\n[a]',
    '[a]\n[[a]]',
    'a.b=1\na.c=2',
    'a.b=1\na.b.c=2',
    '[a.b]\n[a]',
    '[a]\nb.c=1\n[a.b]',
    'a={b=1}\n[a.c]',
    'a={b=1,b=2}',
    'a={b.c=1,b.d=2}',
    'a={b={},b.c=1}',
    'a=[{x=1},{x=2}]',
    'a=[{x=1,x=2}]',
    '[a.b.c]\n[a]\nb.d=1',
    '[[a]]\nb=1\n[[a]]\nb=2\n[a.c]\nx=1\n[a.c]',
    '"a"=1\na=2',
    '\'a\'=1\n"\\u0061"=2',
    'a="\\uD800"',
    'a.b=1\n[a]',
    '[a]\nx=1\n[b]\n[a.c]\n[c]\n[a.c.d]',
    'a=[1,[2,[3]]]',
    'a=[]\n[[a]]',
    'b={}\nb.x=1',
    '[x]\n[x.y.z]\n[x.y]\n[x.y.z.q]\n',
]


@pytest.mark.parametrize("code", JS_VALID)
def test_javascript_valid(code):
    assert lang_javascript.parse(code)[0]


@pytest.mark.parametrize("code", JS_INVALID)
def test_javascript_invalid(code):
    assert not lang_javascript.parse(code)[0]


def _python(code):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(code)
            return True
        except (SyntaxError, ValueError):
            return False


@pytest.mark.parametrize("code", PYTHON)
def test_python(code):
    assert lang_python.parse(code)[0] == _python(code)


def test_python_library_files_and_slips():
    files = sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))
    rng = random.Random(5)
    rng.shuffle(files)
    for f in files[:60]:
        with open(f, encoding="utf-8") as src:
            text = src.read()
        assert lang_python.parse(text)[0] == _python(text), f
        for _ in range(2):
            i, k = rng.randrange(max(1, len(text))), rng.random()
            slip = text[:i] + text[i + 1 :] if k < 0.4 else text[:i] + rng.choice("(){}[]:,.'\"\\=*") + text[i:] if k < 0.8 else text[:i]
            assert lang_python.parse(slip)[0] == _python(slip), (f, i, k)


def _toml(code):
    try:
        tomllib.loads(code)
        return True
    except (ValueError, RecursionError):
        return False


@pytest.mark.parametrize("code", TOML)
def test_toml(code):
    assert lang_data.parse_toml(code)[0] == _toml(code)


def test_toml_tables_at_random():
    rng = random.Random(0)
    for _ in range(3000):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            k = ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
            lines.append(rng.choice([f"[{k}]", f"[[{k}]]", f"{k}=1", f"{k}={{}}", f"{k}={{a=1,{rng.choice('ab')}.c=2}}", f"{k}=[{{a=1}},[]]"]))
        code = "\n".join(lines)
        assert lang_data.parse_toml(code)[0] == _toml(code), code


def test_depth():
    d = 20_000
    assert lang_data.parse_json("[" * d + "]" * d)[0] and lang_data.parse_json('{"a":' * d + "1" + "}" * d)[0] and not lang_data.parse_json("[" * d)[0]
    assert lang_data.parse_toml("a=" + "[" * d + "]" * d)[0]
    assert lang_javascript.parse("x=" + "[" * d + "]" * d)[0] and lang_javascript.parse("if(a){" * d + "}" * d)[0]
    assert lang_javascript.parse("".join(f"if (a == {i}) {{ b() }} else " for i in range(d)) + "c()")[0]
