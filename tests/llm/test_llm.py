"""Operators for model data: against exact parsers, brute force and literal cases."""

import ast
import json
import random
import time
import tomllib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import lang_data, lang_javascript, lang_python, p1_parse, p2_pairs, p6_packing, p7_mixing, p8_sentences

PYTHON = [
    "", "\n", "x = 1", "x = = 1", "if x:\n    pass\nelse:\n  y", "if x:\npass", "def f(a, /, b=1, *c, d, **e): return a", "def f(a=1, b): pass", "f(a=1, b)", "f(*a, b, c=1, **d)",
    "print 1", "f'{a!r:>{w}}'", "f'{a'", "f'{}'", "f'{{}}'", "'abc", '"""a\nb', "x = (1,\n  2\n", "match x:\n    case [1, *_] if y:\n        pass\n    case {'a': b, **c}: pass", "match = 1\nmatch(x)\ncase = [match]",
    "try:\n    a\nexcept* E as e:\n    b\nfinally:\n    c", "try:\n    a\n", "@d\nclass A(B, m=1):\n    x: int = 2\n", "@d\nx = 1", "lambda *a, b=1: (yield)", "a = b = *c, d", "f() = 1", "a + 1 = 2", "del a, b.c, d[0]", "del f()",
    "async def f():\n    async with a as b, c: await d\n    return [x async for x in y]", "0777", "0x_f + 1_000 + .5e3j", "1__0", "x = 5 if y else", "not a in b", "a < not b", "from . import (a, b as c,)", "from a import *", "import a.b as c, d",
    "type X[T: int] = list[T]", "def f[T](x: T) -> T: ...", "with (open(a) as b, c): pass", "for x, *y in z: pass\nelse: pass", "while 1: break", "x: int", "(x): int = 1", "x = 1; y = 2;", "if a: b; c\nd", "\tif a:\n\t\tb\n", "if a:\n\tb\n        c\n",
    "a = [\n1,\n# c ]\n2]", "s = 'a\\\nb'", "if a and \\\n   b:\n    c", "x = {**a, 'b': 1}", "x = {1, *a}", "x[1:2, ::3, *a]", "global x\nnonlocal y", "return 1", "<<<<<<< a\nx", "x = 1\n=======\n", "assert a, 'b'", "raise A from b", "a @= b", "(a := 1)", "a := 1", "else: x", "ünï = 1", "x?", "x = $", "r'\\'", "b'a' 'b'" if False else "rb'a\\'b'",
]


@pytest.mark.parametrize("code", PYTHON)
def test_python_equals_the_interpreter(code):
    try:
        ast.parse(code)
        want = True
    except SyntaxError:
        want = False
    assert lang_python.parse(code)[0] == want


def _cut(text, rng):
    a = rng.randrange(len(text))
    return rng.choice([text[:a], text[:a] + text[a + 1 :], text[:a] + rng.choice("()[]{},:=\"'\n") + text[a:]])


def test_data_languages_equal_exact_parsers():
    rng = random.Random(7)
    docs = ['{"a": [1, -2.5e3, true, null, {"b": "x\\n\\u00e9"}], "c": {}}', '[[], {}, "a", 0]']
    for doc in docs:
        for _ in range(300):
            text = _cut(doc, rng)
            try:
                json.loads(text)
                want = True
            except ValueError:
                want = False
            assert lang_data.parse_json(text)[0] == want, text
    toml = 'title = "x"\nn = [1, 2,\n  3]  # c\n[a.b]\nc.d = {e = 1, f = \'g\'}\nt = 1979-05-27T07:32:00Z\n[[h]]\nm = """\na\nb"""\nf = 1.5\n'
    for _ in range(400):
        text = _cut(toml, rng)
        try:
            tomllib.loads(text)
            want = True
        except tomllib.TOMLDecodeError as e:
            want = "overwrite" in str(e) or "twice" in str(e)  # names, not syntax
        assert lang_data.parse_toml(text)[0] == want, text


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("", True), ("const f = async (a, {b = 1, ...c}) => { await a?.b?.[0] ?? c; };", True), ("let x = a / b / c; /re[/]x/g.test(`a${`n${1}`}b`)", True), ("for (const x of y) z(x)\nwhile (1) { break }", True),
        ("class A extends B { #p = 1; static async *m() { yield* this.#p } get x() { return 1 } }", True), ("import a, { b as c } from 'd';\nexport default function () {}", True), ("x = {a, b() {}, [c]: 1, ...d}", True),
        ("a\n++b", True), ("return", True), ("if (a) {", False), ("x = ;", False), ("f(a,, b)", False), ("`abc", False), ("'abc", False), ("<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", False), ("let a b", False), ("var a = 08;", True), ("label: for (;;) { continue label }", True), ("new.target; new A(1).b()", True), ("/* a", False), ("a => b => ({c})", True), ("do x(); while (y) z()", True), ("switch (a) { case 1: b; default: c }", True), ("x = a ? b : c ? d : e", True), ("}", False),
    ],
)
def test_javascript(code, want):
    assert lang_javascript.parse(code)[0] == want


def test_verdicts(spark):
    rows = [(1, "a.PY", "<reponame>x\ndef f(:\n"), (2, "b.json", ""), (3, "c.toml", ""), (4, "d.txt", "("), (5, None, "("), (6, "e.py", None), (7, "f.py", "x = 1\n<<<<<<< a\ny\n=======\nz\n>>>>>>> b\n"), (8, "g.py", "def f():\n    x = [1,\n"), (9, "h.py", "{\"a\": null}"), (9, "h.py", "{\"a\": null}"), (10, "i.json", "x = 1")]
    df = spark.createDataFrame(rows, "row_id long, path string, text string").withColumn("parses", F.lit("clash"))
    got = {r.row_id: (r.parses, r.cause) for r in p1_parse.parse_check(df, "text", p1_parse.language_of(F.col("path")), [F.col("row_id")]).collect()}
    assert got == {1: (False, got[1][1]), 2: (False, "truncated"), 3: (True, None), 7: (False, "merge_conflict"), 8: (False, "truncated"), 9: (True, None), 10: (False, "looks_like_python")}
    assert lang_python.position("ab = = 1", 2) == 5


PAIRS = [
    (1, "Translate into German: The small model now counts words well.", "Das kleine Modell zählt Wörter jetzt gut.", None),
    (2, "Translate into German: The small model now counts words well.", "The small model now counts words very well for the others.", "wrong_language"),
    (3, "In simple words, how does a lever work?", "<think>hm</think>\u200b \n- \n", "empty"),
    (4, "In simple words, how does a lever work?", None, "empty"),
    (5, "In simple words, how does a lever work?", "Question: in simple words, how does a levver work", "copied_question"),
    (6, "Explain a lever.", "I'm sorry, but I can't help with that request.", "refusal"),
    (7, "Write to Ugo and turn down the invitation.", "Hi Ugo,\n\nI am sorry, but I cannot come on Monday. I am unable to move another appointment.\n\nThanks,\nTavin", None),
    (8, "Explain a lever.", "A lever is easier than it sounds. It moves the", "truncated"),
    (9, "Explain a lever.", "```python\nx = 1", "truncated"),
    (10, "A file has 5 rows and 2 are removed. How many are left?", "3", None),
    (11, None, "The answer is here.", None),
    (12, "Explique le levier en deux phrases.", "Je ne peux pas répondre à cette demande.", "refusal"),
    (8, "Explain a lever.", "A lever is easier than it sounds. It moves the", "truncated"),
]


def test_pairs(spark):
    filler = [(100 + i, "Explain it.", f"The team moves the heavy stones near the river. It moves the box{i}. Then the lever rests.") for i in range(30)]
    df = spark.createDataFrame([p[:3] for p in PAIRS] + filler, "row_id long, prompt string, answer string").withColumn("defect", F.lit(1))
    got = {r.row_id: r.defect for r in p2_pairs.defects(df, "prompt", "answer").collect()}
    assert got == {p[0]: p[3] for p in PAIRS if p[3]}
    assert p2_pairs.defects(df.limit(0), "prompt", "answer").count() == 0


def test_prompts_given_back_several_times():
    ask = "Turn this into 3 short bullets: After 342 steps the memory was almost empty. Bettina needs the numbers."
    text, two = ask.partition(": ")[2], "Rewrite this.\n\nText: After 342 steps the memory was almost empty."
    assert p2_pairs.copied(ask, f"{ask}\n\n{ask}") and p2_pairs.copied(ask, f"{ask} {ask}\n{ask}") and p2_pairs.copied(two, f"{two}\n\n{two}")
    assert p2_pairs.copied(ask, f"{ask}\n\n{text}") and p2_pairs.copied(ask, f"Question: {ask}\nQuestion: {ask}") and p2_pairs.copied(ask, f"{ask}\n---\n{ask[:60]}")
    assert not p2_pairs.copied(ask, f"{ask}\n\nThe memory is nearly empty now, so send Bettina the figures.")
    assert not p2_pairs.copied(ask, f"{ask}\n\n{ask.replace('342', '343')}") and not p2_pairs.copied(ask, ask[:60])


def test_long_refusals():
    no = "I'm sorry, but I can't help with that request."
    reasons = " The text names a private person and gives an address, so it stays closed." * 12
    assert p2_pairs.refused(no + reasons) and p2_pairs.refused("Thanks for asking. " + no + reasons) and p2_pairs.refused(f"Hello,\n\n{no}")
    assert p2_pairs.refused("Je ne peux pas répondre à cette demande." + reasons)
    assert not p2_pairs.refused(reasons.strip() + " The clerk said: " + no)
    assert not p2_pairs.refused(f"Hi Ugo,\n\n{no}\n\nThanks,\nTavin") and not p2_pairs.refused(f"Hello,\n\n{no}\n\nThanks,\nTavin")


def test_sentence_with_many_possible_ends():
    s = "ab. " * 300
    ends = [(4 * k + 3, 4 * k + 4, -1.0, -1) for k in range(299)]
    assert p8_sentences._best(s, 0, 0, len(s) - 1, ends, {}) == [(0, len(s) - 1)]
    ends[150] = (603, 604, 3.0, -1)
    assert p8_sentences._best(s, 0, 0, len(s) - 1, ends, {}) == [(0, 603), (604, len(s) - 1)]


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 3, 10, 17, 64, 100, 200, 333])) for i in range(500)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(5)
    packs = [("a", 100), ("b", 64)]
    got = p6_packing.pack(df, packs, windows=4).collect()
    for name, cap in packs:
        rows = [r for r in got if r.pack_name == name]
        fill = {}
        for r in rows:
            fill[r.block] = fill.get(r.block, 0) + r.to_token - r.from_token
        assert max(fill.values()) <= cap
        for i, n in sizes:
            pieces = sorted((r.from_token, r.to_token) for r in rows if r.doc_id == i)
            assert sum(b - a for a, b in pieces) == n and all(x[1] == y[0] for x, y in zip(pieces, pieces[1:]))
            assert len(pieces) == (0 if n == 0 else 1 if n <= cap else -(-n // cap))
        assert sum(fill.values()) / (len(fill) * cap) > 0.85
    assert p6_packing.pack(df.limit(0), packs).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "x", None]), rng.choice([0, 50, 120, 300, 900])) for i in range(3000)] + [(9000, "a", 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").repartition(3)
    targets = [("a", 50.0, 2), ("b", 30.0, 2), ("c", 20.0, 3), ("gone", 5.0, 2)]
    mixture, need, supply = p7_mixing.mix(df, targets)
    rows = mixture.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    most = {s: m for s, _, m in targets}
    assert all(1 <= r.times <= most[r.source] for r in rows)
    total = sum(r.n_tokens * r.times for r in rows)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.n_tokens * r.times for r in rows if r.source == s) / total - w) < 0.002
    shares = {r.source: r for r in p7_mixing.shares(mixture, need, supply, targets).collect()}
    assert shares["gone"].used_tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-4


def test_flight_keeps_totals():
    rng = random.Random(1)
    units = [[i, rng.randrange(1, 500), rng.random()] for i in range(300)]
    tokens, count = sum(u[1] * u[2] for u in units), sum(u[2] for u in units)
    out = p7_mixing.fly(units, 2, rng)
    assert len(out) == 300 and sum(1e-9 < u[2] < 1 - 1e-9 for u in out) <= 2
    assert abs(sum(u[1] * u[2] for u in out) - tokens) < 1e-3 and abs(sum(u[2] for u in out) - count) < 1e-5


SENTENCES = [
    "Dr. Ada met J. R. Kesti at 9:30 a.m. and left.| It cost $8.71.| See Fig. 2, e.g. the left one.",
    "“Stop! You will lose it!” Corvin shouted although nobody asked.| Fine.",
    "Wenka's note reads: 'Keep it short. No lists.'| It rained.",
    "Well... that was not it.| The shards were gone...| Nobody knew.",
    "Why?What next?| (The pass took 32.06 hours.)| U.S. and U.K. spellings occur.",
    "# A heading\n|Text goes\non here.| Next one.\n\n|- item one\n|- item two. |With more.",
    "```python\nprint('a. b.')\n\nx\n```\n|Hello Ada,\n|Done.",
    "Es waren ca. 1.493 Zeilen, vgl. Abb. 7.| Dr. Ugo kam am 9. Juli nach Ostrel.| „Ist es fertig?“, fragte Ugo.",
    "从1998年起，树长着。|“停！别删！”布拉莫喊道。|塔文说：“够了。明天再继续。”|文件有4.5MB……太大了。",
    "「待って！消さないで！」とルドラは叫びました。|えっ…本当ですか？|料金は41.31円（送料込み。返金不可）です。",
    "В 2010 г. проф. Зелия работал.| Купили яблоки, карты и т. д.| Никто не знает!| А. Б. Янто ушёл.",
    "सेब के पेड़ हैं।| \"क्या काम पूरा हुआ?\" पेरिन ने पूछा।",
    "เด็กอ่านนิทานเรื่องใหม่ทุกวัน  |ยันโตตรวจข้อมูลที่วาร์นโฮล์มเมื่อเช้านี้",
    "User: One thing.| Two things.\r\n\r\n|  \r\n|Three.",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_sentences(marked):
    if marked.startswith("Why?"):
        marked = marked.replace("Why?What", "Why?|What")
    text = marked.replace("|", "")
    want = [p.strip() for p in marked.split("|") if p.strip()]
    got = p8_sentences.sentences(text)
    assert [text[a:b] for a, b in got] == want


def test_sentences_cover_any_text():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("ab AB.!?…。「」“”()'\"\n\n\t-#1. ไทย ॥।") for _ in range(rng.randrange(120)))
        spans = p8_sentences.sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(text[a:b] for a, b in spans).replace(" ", "").split() == "".join(text.split(" ")).split() or {*text} - {*"".join(text[a:b] for a, b in spans)} <= {" ", "\n", "\t"}
    assert p8_sentences.sentences(None) == [] and p8_sentences.sentences(" \n\u3000") == []


def test_settled_tokens_meet_the_expected_total():
    for seed in range(6):
        rng = random.Random(seed)
        units = [[i, int(rng.lognormvariate(4, 1.5)) + 1, 0.1] for i in range(1000)]
        want = sum(u[1] * u[2] for u in units)
        flown = [u for k in range(4) for u in p7_mixing.fly(sorted(units[k::4], key=lambda u: -u[1]), 64, rng, 512)]
        landed = p7_mixing.settle([u for u in flown if p7_mixing._open(u)], rng)
        assert all(min(u[2], 1 - u[2]) < 1e-6 for u in units)
        assert abs(sum(u[1] * u[2] for u in units) - want) <= 1 and len(landed) < 60  # of 1,000, whatever their number


def test_mixing_levels(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, "ab"[i % 2], int(rng.lognormvariate(4, 1.5)) + 1) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").repartition(9)
    monkeypatch.setattr(p7_mixing, "FAN_IN", 3)
    mixture, need, _ = p7_mixing.mix(df, [("a", 1.0, 1), ("b", 3.0, 1)])
    rows = mixture.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    for s, (_, tokens) in need.items():
        assert abs(sum(r.n_tokens for r in rows if r.source == s) - tokens) <= 1


@pytest.mark.parametrize(
    "text",
    ["Das kann ich nicht machen.", "Lo siento, pero no voy a hacer eso.", "je préfère ne pas répondre à cette demande", "I would rather not do that.", "Sorry, that's not something I'm able to do.", "这个我帮不了你。", "Answering would not be appropriate for me."],
)
def test_refusals_by_structure(text):
    assert p2_pairs.refused(text) and p2_pairs.refused(text + "\nThe weather was fine and the boats went out early." * 30)


def test_no_refusals():
    for text in (
        "The clerk wrote: I cannot help with that, and hung up. Then the story went on.", 'She said "I can\'t help with that" and left.',
        "I am sorry, but I cannot come to Tolvik on Saturday.", "You do not need to answer.", "El proceso no puede ir.", "",
    ):
        assert not p2_pairs.refused(text)


def test_languages_of_short_texts():
    assert p2_pairs.language("Tôi không biết") == "vi" and p2_pairs.language("Das ist gut für dich") == "de" and p2_pairs.language("42") is None


def test_nothing_is_truncated_for_want_of_other_rows(spark):
    rows = [(1, "Capital of France?", "Paris"), (2, "Who wrote it?", "It was William Shakespeare"), (3, "Why?", "We left because the")]
    df = spark.createDataFrame(rows, "row_id long, prompt string, answer string")
    assert [(r.row_id, r.defect) for r in p2_pairs.defects(df, "prompt", "answer").collect()] == [(3, "truncated")]


def test_endings_by_counts(spark):
    rows = [(i, "Who?", f"The letters were sent by {n} after the long meeting in town. They were read by {n}.") for i, n in enumerate(["Ada", "Bo", "Cyd", "Dan", "Eli", "Fay"] * 40)]
    rows += [(900, "Who?", "The letters were sent by Ada after the long mee"), (901, "Who?", "They were read by Zed"), (902, "Who?", "The letters were sent"), (903, "How many? Only the number.", "How many? Only the number.\n\n7")]
    df = spark.createDataFrame(rows, "row_id long, prompt string, answer string")
    got = {r.row_id: r.defect for r in p2_pairs.defects(df, "prompt", "answer").collect() if r.row_id >= 900}
    assert got.get(900) == "truncated" and got.get(902) == "truncated" and 903 not in got


def test_spans_are_scored_jointly():
    """Both places by themselves would end a sentence; the span between them is too short to be one."""
    text = "We saw Plan W. The X. The rest was gone."
    for at in (13, 20):
        nxt = at + 2
        assert p8_sentences._closing(text, at, ".", nxt, True) + p8_sentences._opening(text, nxt) > 0
    assert len(p8_sentences.sentences(text)) == 2  # not 3
    # the same quotation and speaker: whole where it begins its sentence, closed where words lead to it
    assert len(p8_sentences.sentences("It rained. “Stop it now!” Corvin shouted at them.")) == 2
    assert len(p8_sentences.sentences("The sign read “Stop it now!” Corvin shouted at them.")) == 2


def test_far_starts_change_nothing(monkeypatch):
    rng = random.Random(3)
    parts = ["Mr. Smith", "went on. ", "“Stop! Go!” ", "Corvin shouted. ", "The U. ", "e.g. this, ", "He said: ", "J. R. ", "停！", "“别删！”", "ไทย ", "(so. it) ", "Long words follow here without any end ", "7. ", "etc. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    got = [p8_sentences.sentences(t) for t in texts]
    monkeypatch.setattr(p8_sentences, "FAR", 10**9)
    assert [p8_sentences.sentences(t) for t in texts] == got


def test_long_sentences_stay_whole():
    text = "He met " + "Mr. Smith and " * 30_000 + "nobody else."
    assert p8_sentences.sentences(text) == [(0, len(text))]
    many = "The cat sat on the mat, and nobody asked. " * 25_000
    began = time.time()
    assert len(p8_sentences.sentences(many)) == 25_000 and time.time() - began < 20
    assert len(p8_sentences.sentences("Dear " + "Ada, " * 30 + "\nIt is late.")) >= 1
