"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming.

A text is cut into segments that no sentence crosses: fenced code blocks, paragraphs (blank lines), list
items, headings and greeting lines. Within a segment every terminal mark (in Thai: every space) is a place
where a sentence may end, and dynamic programming picks the sequence of whole spans with the best total
score. A span's score joins four things: how it opens (an opening word), how it closes (marks,
abbreviations, ordinals, what follows), its length, and its balance: quotation marks and brackets must be
whole in it, and a quotation that the span begins with keeps the clause that names the speaker. The script
decides, not the language column, so wrong or missing languages don't matter.

All starts are looked back to. Of those at least ``FAR`` characters behind, only the ones that no later start
equals or beats are kept, which is exact because from there on a longer span never scores more.

Defined results: a null, empty or blank text has no sentences; offsets are code points of the raw text
without outer white space; any kind of line end works; repeated texts are cut alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From this size on, a longer span never scores more (see ``_length``).
FAR = 80
#: The score of what can't be.
NEVER = -1e6

_LINE = re.compile(r"[^\r\n\x0b\x0c\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x85  ]|\Z)")
_FENCE = re.compile(r"\s{0,3}(```+|~~~+)")
_ITEM = re.compile(r"\s*(?:[-*•–·‣+]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))[ \t ]+(?=\S)")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s+\S")
_GREETING = re.compile(
    r"\s*(?:hi|hello|hey|dear|good (?:morning|evening|afternoon)|hallo|liebe[r]?|guten (?:tag|morgen|abend)|sehr geehrte[r]?|bonjour|bonsoir|salut|ch[eè]re?|hola|querid[oa]|estimad[oa]|buen[oa]s \w+|привет|здравствуй(?:те)?|дорог(?:ой|ая)|уважаем(?:ый|ая)|مرحبا|नमस्ते|प्रिय|สวัสดี|亲爱的|你好|您好)\b[^.!?。！？।\n]{0,60}[,،，:：!]\s*\Z",
    re.I,
)
_TERMINAL = re.compile(r"(?:\.{2,}|…+|[.!?！？｡。؟۔।॥]|‼|⁇|⁈|⁉)+")
_OPEN = "([{（［【「『《〈“‘«„‹"
_CLOSE = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈", "»": "«", "›": "‹"}
_MARKS = re.compile("[" + re.escape(_OPEN + "".join(_CLOSE) + "”’\"'") + "]")
_CLOSERS = ")]}）］】」』》〉»›”’“\"'"
_NUMBER = re.compile(r"\d")

#: Abbreviations that stand before something and don't end a sentence.
BEFORE = set(
    "mr mrs ms mx dr prof rev gen col capt lt sgt hon st mt fig figs sec secs no nos vol vols ch pp p eq ref refs vs cf eg ie e.g i.e approx ca incl excl viz al ed eds dept est resp"
    " abb vgl nr bzw z.b z b d.h d h u.a u a o.ä sog evtl ggf inkl str hr fr dipl ing bd s tel usf.b zzgl abs art kap"
    " m mm mme mlle mlles me env c.-à-d c.-a-d p.ex ex cf n° av boul éd chap"
    " sr sra srta dra d.ª dña ud uds núm num pág págs aprox p.ej ej ee avda lic ing tel"
    " т.е т проф др акад ок см рис стр гл ул им напр гр св тов руб.о"
    " д أ د م डॉ श्री कु प्रो सं ดร ศ รศ ผศ นพ พญ".split()
)
#: Abbreviations that may also end one.
EITHER = set("etc usw u.s.w bzw.e a.m p.m am pm a.m p.m inc ltd co corp jr sr.e bros u.s u.k u.s.a e.u д т.д т.п п др.е г гг в вв млн млрд тыс ч мин сек руб коп кв м см.е км h hs uu ee.uu ss mio mrd tsd min sek std ฯลฯ น พ.ศ".split())
MONTHS = set(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez"
    " january february march may june july october december".split()
)
#: Words that often open a sentence.
OPENERS = set(
    "the a an it this that these those there he she we they i you in on at as if when while after before once because for by what why how who where did does do is are was can nobody someone everyone one each some many most all no every our my his her their its but and so then now well strangely first over with without think keep run see mails"
    " der die das ein eine es er sie wir ihr ich in im am an auf wenn wer was wie warum wo niemand ohne für am als dann aber und viele nach"
    " le la les un une il elle nous vous on ce cette dans sur pour sans qui que quand pourquoi personne depuis beaucoup mais et"
    " el los las un una es él ella en para sin quien cuando por nadie desde muchos pero y se al"
    " в на с для без кто когда почему никто он она мы они это и но тот".split()
)
SPEECH = (
    r"said|says|asked|asks|shouted|cried|whispered|replied|answered|called|yelled|added|murmured|muttered|wrote|explained|sighed|laughed|exclaimed|thought|warned|told|begged|demanded|insisted|remarked|repeated|screamed|continued|announced|agreed|wondered|admitted|declared|mumbled|snapped"
    r"|sagte|fragte|rief|schrie|antwortete|meinte|flüsterte|erklärte|erwiderte|dachte|schrieb|murmelte|ergänzte|lachte|sagt|fragt|ruft"
    r"|dit|demanda|demande|cria|répondit|murmura|ajouta|s'écria|s’écria|expliqua|lança|reprit|écrivit|pensa|chuchota|soupira"
    r"|dijo|preguntó|gritó|respondió|contestó|susurró|añadió|exclamó|explicó|pensó|murmuró|escribió|pregunta|dice"
    r"|сказал[аи]?|спросил[аи]?|крикнул[аи]?|закричал[аи]?|ответил[аи]?|прошептал[аи]?|добавил[аи]?|воскликнул[аи]?|подумал[аи]?|написал[аи]?|говорит|спрашивает|disse|chiese|perguntou"
)
_SPEECH = re.compile(r"\W*(?:[^\W\d_]+[ \t\n]+){0,3}?(?:" + SPEECH + r")\b", re.I)
_SPEECH_AR = re.compile(r"\s*(?:سأل|سألت|قال|قالت|صاح|صاحت|أجاب|أجابت|هتف|همس|رد|كتب)")
_SPEECH_HI = re.compile(r"[^।?!]{0,40}?(?:पूछा|कहा|बोला|बोली|चिल्लाया|चिल्लाई|लिखा|सोचा|जवाब दिया)")
_SPEECH_ZH = re.compile(r"[^。！？…“”「」]{0,14}?(?:说|問|问|喊|叫|答|道|嚷|写|想|說|寫)")
_SPEECH_JA = re.compile(r"(?:と|って|など|という|とか|は|が|を|に|の|も|で)")
_CJK, _THAI = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]"), re.compile(r"[฀-๿]")
_KANA = re.compile(r"[぀-ヿ]")
_WORD_BEFORE = re.compile(r"([^\W_]+(?:[.'’-]{1,2}[^\W_]+)*(?:\.[- ]?[^\W\d_]{1,3})*)\Z")
_THAI_NOT_OPEN = re.compile(r"(?:แล้ว|และ|หรือ|อยู่|พร้อม|ฯลฯ|เป็น|ใน|จึง|โดย|ซึ่ง|ของ|เพื่อ|ยัง|ได้|จาก|ถึง|กว่า|แต่|ให้|ๆ|กับ|ที่(?!ประชุม))")
_THAI_NOT_CLOSE = re.compile(r"(?:ปี|จาก|เป็น|กับ|(?<!ก)ว่า|เวลา|ตอน|รุ่น|ตั้งแต่|และ|หรือ|ของ|ดร\.|จะ|เพราะ|ที่ว่า|คือ|นับ)\Z")


def segments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the pieces that no sentence crosses; whole ones are a unit as they are."""
    pos, n, start = 0, len(text), None
    fence, fence_at = "", 0

    def flush(end: int) -> Iterator[tuple[int, int, bool]]:
        nonlocal start
        if start is not None:
            yield start, end, False
            start = None

    while pos < n:
        m = _LINE.match(text, pos)
        line, begin, pos = m.group(), pos, m.end()
        f = _FENCE.match(line)
        if fence:
            if f and f.group(1).startswith(fence) and not line[f.end() :].strip():
                yield fence_at, pos, True
                fence = ""
            continue
        if f:
            yield from flush(begin)
            fence, fence_at = f.group(1), begin
            continue
        if not line.strip():
            yield from flush(begin)
        elif _HEADING.match(line) or _GREETING.match(line):
            yield from flush(begin)
            yield begin, pos, True
        elif _ITEM.match(line):
            yield from flush(begin)
            start = begin
        elif start is None:
            start = begin
    if fence:
        yield fence_at, n, True
    yield from flush(n)


def _pairs(s: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets, the outer ones only."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []

    held: Counter = Counter()  # open marks by kind, so that nothing is looked for in vain

    def push(c: str, i: int) -> None:
        stack.append((c, i))
        held[c] += 1

    def close(kinds: str, i: int) -> None:
        while any(held[k] for k in kinds):
            c, at = stack.pop()
            held[c] -= 1
            if c in kinds:
                found.append((at, i))
                return

    n = len(s)
    for m in _MARKS.finditer(s):
        i, c = m.start(), m.group()
        if c in _CLOSE:
            if c == ")" and not held["("]:
                continue
            close(_CLOSE[c], i)
        elif c == "“" and held["„"]:
            close("„", i)
        elif c == "”":
            close("“„", i)
        elif c == "’":
            if not (0 < i < n - 1 and s[i - 1].isalnum() and s[i + 1].isalnum()):
                close("‘", i)
        elif c in "\"'":
            before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
            if c == "'" and before.isalnum() and after.isalnum():
                continue
            is_open = held[c] > 0
            if not is_open and not after.isspace() and (before.isspace() or not before.isalnum() and before not in ".!?"):
                push(c, i)
            elif is_open and not before.isspace():
                if c == "\"" or not after.isalnum():
                    close(c, i)
        elif c in _OPEN:
            push(c, i)
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


_LETTERS = re.compile(r"[^\W\d_]+")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
#: What an opening word adds to a span.
OPENS = 2.5


def _opening(s: str, start: int) -> float:
    """How well a span opens at ``start``."""
    m = _LETTERS.match(s, start)
    return OPENS if m and m.group().lower() in OPENERS else 0.0


def _closing(s: str, at: int, mark: str, nxt: int, spaced: bool) -> float:
    """How well a span closes with ``mark`` at ``at`` when the next text begins at ``nxt`` (its opening word is scored with the next span)."""
    c = s[nxt]
    lead = c
    if c in "—–-" and nxt + 1 < len(s):
        k = nxt + 1
        while k < len(s) and s[k].isspace():
            k += 1
        lead = s[k] if k < len(s) else c
    opening = c in "¿¡([{（「『“‘«„‹\"'《【`*" or lead in "¿¡"
    if c in ",;:،、，；)":
        return NEVER
    dots = len(mark) > 1 and set(mark) <= {".", "…"} or mark[0] == "…"
    cjk = _CJK.match(c) is not None
    if dots:
        return 2.0 if lead.isupper() or opening else NEVER
    full = mark[-1] in "。！？｡।॥؟۔" or any(x in mark for x in "!?")
    if full:
        if mark[-1] in "。！？｡।॥":
            return 3.0
        if lead.islower():
            return -3 - OPENS if spaced else NEVER
        if mark[-1] in "!?" and not spaced and not cjk and not lead.isupper() and not opening and lead.isascii():
            return NEVER
        return 3.0
    # a single dot
    if not spaced:
        if lead.isupper() and s[nxt + 1 : nxt + 2].islower() and at and (s[at - 1].islower() or s[at - 1] in ")]\"’”"):
            return 1.5
        return 2.0 if cjk and at and _CJK.match(s[at - 1]) else NEVER
    if lead.islower():
        return NEVER
    m = _WORD_BEFORE.search(s[max(0, at - 24) : at])  # (no abbreviation is that long)
    word = m.group(1) if m else ""
    low = word.lower()
    nw = _LETTERS.match(s, nxt)
    after = nw.group().lower() if nw else ""
    last = low.rsplit(" ", 1)[-1]
    tight = low.replace(" ", "")
    short = next((tight[k:] for k in range(len(tight)) if tight[k:] in EITHER and (k == 0 or not tight[k - 1].isalnum())), "")
    if _THAI.match(c):
        return 1.0 if short and not _THAI_NOT_OPEN.match(s, nxt) else NEVER
    if not (short and "." in short) and (tight in BEFORE or last in BEFORE):
        return -4 - OPENS
    if short:
        if c.isdigit():
            return -3
        return -1 if short in ("u.s", "u.k", "u.s.a", "e.u", "uu", "ee.uu", "jr") else 1.5
    word = word.rsplit(" ", 1)[-1]
    if len(word) == 1 and word.isalpha():
        initial = word in "JRABCDEFGHKLMNPST" or not word.isupper() and (lead.isupper() or lead.isascii())
        return -4 - OPENS if initial else 0.5 - OPENS  # (letters that seldom end a sentence)
    if _DOTTED.fullmatch(low):
        return 1.0 - OPENS
    if word.isdigit() and len(word) <= 2 and after in MONTHS:
        return -5 - OPENS
    if c.isdigit() and word.isalpha():
        return -4 if len(word) <= 4 or word.lower().endswith("str") else 1.0
    if "ऀ" <= c <= "ॿ" and not opening:
        return -2
    return 2.0


def _thai(s: str, a: int, b: int) -> float:
    """How well a sentence closes at the space between a and b in Thai text."""
    before = s[a - 1]
    if not (_THAI.match(s, b) and (_THAI.match(before) or before in "”\"')»")):
        return 2.5 if s[b] in "“\"(«" and before not in ",:" and b - a > 1 else NEVER
    if _THAI_NOT_OPEN.match(s, b) or _THAI_NOT_CLOSE.search(s, max(0, a - 12), a) or before in "ๆฯ":
        return -6
    if before in "”\"'»" and not s[a : a + 1] == "\n":
        return -1
    return 2.0 + (1.5 if b - a > 1 and s[a:b].strip("  ") == "" else 0)


def cut(s: str) -> list[tuple[int, int]]:
    """The sentences of one segment."""
    n = len(s.rstrip())
    first = len(s) - len(s.lstrip())
    if first >= n:
        return []
    item = _ITEM.match(s)
    body = item.end() if item else first
    outer = _pairs(s[:n])
    stops: list[tuple[int, int, float, int]] = []  # (end, start of the next, how it closes, head of a quotation that ends here)
    pi = 0
    closed_by = {b: a for a, b in outer}
    kana = bool(outer) and _KANA.search(s) is not None
    for m in _TERMINAL.finditer(s, body, n):
        at, end = m.start(), m.end()
        while end < n and s[end] in _CLOSERS and (end in closed_by or s[end] in "”’»）)」』" and not any(a < end < b for a, b in outer[pi : pi + 2])):
            end += 1
        if end < n and s[end : end + 2] in (" »", " »", " »") and end + 1 in closed_by:
            end += 2
        while pi < len(outer) and outer[pi][1] < end:
            pi += 1
        nxt = end
        while nxt < n and s[nxt].isspace():
            nxt += 1
        if nxt >= n:
            break
        head = closed_by.get(end - 1, -1)
        if pi < len(outer) and outer[pi][0] < end <= outer[pi][1]:
            score = NEVER  # both spans at this place would have half a quotation or bracket
        else:
            score = _closing(s, at, m.group(), nxt, nxt > end or end > m.end())
            if head >= 0 and score > NEVER:
                score = _after_quote(s, kana, head, end, nxt, score)
        stops.append((end, nxt, score, head))
    if _THAI.search(s):
        tokens = [(t.start(), t.end()) for t in re.finditer(r"\S+", s[:n])]
        listed = set()
        for k, (a, b) in enumerate(tokens):
            if s.startswith("ฯลฯ", a):
                j = k
                while j > 0 and (j == k or b2 - a2 <= 8):
                    listed.add(tokens[j][0])
                    j -= 1
                    a2, b2 = tokens[j]
        qi = 0
        for (_, b), (c, _) in zip(tokens, tokens[1:]):
            while qi < len(outer) and outer[qi][1] < b:
                qi += 1
            half = qi < len(outer) and outer[qi][0] < b <= outer[qi][1]
            if b > body and c not in listed:
                stops.append((b, c, NEVER if half else _thai(s, b, c), -1))
        stops.sort()
    return _best(s, first, body, n, stops, closed_by)


def _after_quote(s: str, kana: bool, head: int, end: int, nxt: int, score: float) -> float:
    """The score of closing right behind a quotation or bracket."""
    c = s[nxt]
    if s[head] in "([（":
        return score if not c.islower() else NEVER
    if s[end - 1] in "」』" and kana and _SPEECH_JA.match(s, nxt):
        return NEVER
    if c.islower() or c in ",;:–—-":
        return NEVER
    return score


def _speaks(s: str, nxt: int) -> bool:
    """Whether the text after a quotation names its speaker."""
    c = s[nxt]
    if _CJK.match(c):
        return bool(_SPEECH_JA.match(s, nxt) if _KANA.search(s, nxt, nxt + 80) else _SPEECH_ZH.match(s, nxt))
    if "؀" <= c <= "ۿ":
        return _SPEECH_AR.match(s, nxt) is not None
    if "ऀ" <= c <= "ॿ":
        return _SPEECH_HI.match(s, nxt) is not None
    return _SPEECH.match(s, nxt) is not None


def _introduced(s: str, head: int, body: int) -> bool:
    """Whether words of the same sentence lead to the quotation that begins at ``head``."""
    k = head - 1
    while k >= body and s[k].isspace():
        k -= 1
    while k >= body and s[k] in _CLOSERS:
        k -= 1
    return k >= body and _TERMINAL.match(s, k) is None


#: What a quotation loses that is cut off from the clause naming its speaker.
SPEAKERLESS = -20.0


def _best(s: str, first: int, body: int, n: int, stops: list[tuple[int, int, float, int]], closed_by: dict[int, int]) -> list[tuple[int, int]]:
    """The sequence of spans with the best total score."""
    stops = [(first, first, 0.0, -1), *stops, (n, n, 0.0, -1)]
    starts = [body, *(e[1] for e in stops[1:])]
    opens = [_opening(s, x) if x < n else 0.0 for x in starts]
    opens[0] = 0.0  # the segment's own start is given
    tail_of = {a: b for b, a in closed_by.items()}
    best = [0.0] + [-1e18] * (len(stops) - 1)
    back = [0] * len(stops)
    ordered = all(x <= y for x, y in zip(starts, starts[1:]))
    far: list[int] = []
    waiting: list[int] = []  # far starts whose own quotation isn't closed yet
    passed = 0  # starts before this one are far

    def to_far(i: int) -> None:
        while far and best[far[-1]] + opens[far[-1]] <= best[i] + opens[i]:
            far.pop()
        far.append(i)

    last = len(stops) - 1
    for j in range(1, len(stops)):
        end, nxt, score, head = stops[j]
        lost = SPEAKERLESS if head >= 0 and s[head] not in "([（" and nxt < n and _speaks(s, nxt) else 0.0
        if lost and not _introduced(s, head, body):
            score, lost = score + lost, 0.0  # whatever span it closes
        while ordered and passed < j and starts[passed] + FAR <= end:
            if tail_of.get(starts[passed], -1) >= end - 1:
                waiting.append(passed)
            else:
                to_far(passed)
            passed += 1
        for i in [i for i in waiting if tail_of[starts[i]] < end - 1]:
            waiting.remove(i)
            to_far(i)
        top, at = -1e18, 0
        for i in (*range(j - 1, passed - 1, -1), *waiting):
            if starts[i] < end:
                got = best[i] + opens[i] + _length(s, starts[i], end, j == last) + (lost if starts[i] == head else 0.0)
                if got > top:
                    top, at = got, i
        far_top, far_at = -1e18, 0
        for i in far:
            if best[i] + opens[i] < max(top, far_top):
                break
            got = best[i] + opens[i] + _length(s, starts[i], end, j == last)
            if got >= far_top:
                far_top, far_at = got, i
        if far_top > top:  # (of equals, the nearest start)
            top, at = far_top, far_at
        best[j], back[j] = top + score, at
    out, j = [], last
    while j:
        i = back[j]
        out.append((first if i == 0 else stops[i][1], stops[j][0]))
        j = i
    return out[::-1]


def _length(s: str, start: int, end: int, last: bool) -> float:
    size = end - start
    if size < 80 and _THAI.search(s, start, end):
        thai = len(_THAI.findall(s, start, end))
        return -3.0 if thai < 10 and not last else -1.5 if thai < 14 else 0.0
    if size < 8 and not last:
        return -0.8 if any(c.isalnum() for c in s[start:end]) else -4.0
    return -0.02 * max(0, min(size, 4400) - 400) ** 0.5


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text."""
    out = []
    for a, b, whole in segments(text or ""):
        piece = text[a:b]
        if whole:
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if left < right:
                out.append((a + left, a + right))
        else:
            out += [(a + x, a + y) for x, y in cut(piece)]
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, starts, stops = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for x, y in sentences(text):
                ids.append(i)
                starts.append(x)
                stops.append(y)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["doc_id", "start_pos", "end_pos"]
        )


def split_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence unit of every document; a narrow transformation."""
    src = df.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(_batches, "doc_id long, start_pos long, end_pos long")
