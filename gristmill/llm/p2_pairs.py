"""Broken prompt and response pairs: ordered rules, every triggered defect, one main defect.

Rules in order: ``empty``, ``copied_question``, ``refusal``, ``wrong_language``, ``truncated``. Reasoning in
``<think>`` tags is taken out first (an unclosed tag runs to the end).

``refusal``: a sentence of the opening, outside quotations, that declines (a negated or declining verb) and
speaks of answering, the request or its rules and of little else. ``wrong_language``: script first, then
letters that only some languages have, then everyday words. ``truncated``: unclosed code fences, a comma,
colon, opening mark or hyphen at the end; else how often the last one to four words end a sentence or line
anywhere in the answers (names and numbers count as kinds): counts over all answers, never a sample. A last
word that no other answer has tells of a cut only as far as such words are rare in the table (``UNSEEN``), and
where nothing is known of an ending, only a word that needs another one behind it tells.

Defined results: a null or blank answer, or one without a letter or digit, is ``empty``; a null prompt can
be neither copied nor the measure of a language; an answer without words of a known language has none;
repeated rows give one result; texts of any length are read whole (a task is declined at the start).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, spread_join

ORDER = ("empty", "copied_question", "refusal", "wrong_language", "truncated")

_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S | re.I)
_WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_](?:[\w'’.-]*\w)?")
_KANA, _HAN = re.compile(r"[぀-ヿ]"), re.compile(r"[㐀-鿿]")
#: Scripts that tell a language by themselves.
_SCRIPTS = {"th": r"[฀-๿]", "hi": r"[ऀ-ॿ]", "ar": r"[؀-ۿ]", "ru": r"[Ѐ-ӿ]", "ko": r"[가-힯]", "el": r"[Ͱ-Ͽ]", "he": r"[֐-׿]"}
_SCRIPT = {k: re.compile(v) for k, v in _SCRIPTS.items()}
#: Everyday words of languages in Latin script.
STOPWORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never same another know while last might us great old year off come since against go came right used take three i a keep think wrote read went needs goes put please write short explain text list hi thanks best regards soon".split(),
    "de": "der die und das ist nicht ich du er sie es wir ihr ein eine einen einem einer den dem des zu im mit auf für von sich auch als an nach wie bei aus noch nur oder aber um so wenn werden wurde hat haben hatte sind war kann wird über vor durch dass mehr als am zum zur seine ihre jetzt sehr bis ohne unter zwischen gegen alle viele kaum jemand fragt im schon gut fasse nenne schreibe erkläre mach bitte hallo viele grüße danke bald wurden musste muss kennt reicht davon geht sich leider".split(),
    "fr": "le la les un une des du de et est en que qui dans pour pas sur au aux avec ce cette ces il elle nous vous ils elles je tu ne se sa son ses plus par mais ou où sont a été être avoir fait comme tout on leur si peu dont sans sous entre vers chez très aussi bien même donc car alors quand après avant depuis jusqu écris explique donne résume rends reformule bonjour merci cordialement bientôt peut quelques phrases suffit".split(),
    "es": "el la los las un una unos unas de del y es en que quien por para no con su sus se lo le les al más pero como o este esta estos estas son fue ha han hay muy sin sobre entre hasta desde cuando donde todo todos nos yo tú él ella ya si porque también antes después así tan poco mucho nada nadie ser estar tiene hizo escribe explica resume haz reescribe da hola gracias saludo pronto basta puede cada otro otra".split(),
    "it": "il lo gli una uno di che è e non per con del della dei sono ma come più anche questo questa nel nella alla ci si ha ho perché quando molto dopo prima".split(),
    "pt": "o os as um uma de do da dos das e é não em que para com por se na no mais como mas ao foi são ele ela você isso este esta muito também já depois antes quando".split(),
    "nl": "de het een en van is dat in op te niet zijn voor met aan er maar om ook als dan bij nog naar uit door over wordt deze die dit was werd heeft hebben".split(),
}
_STOP: dict[str, set] = defaultdict(set)
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        _STOP[_w].add(_lang)
_MARKS = {"de": re.compile(r"[äöüß„]", re.I), "fr": re.compile(r"[àâçèêëîïôùûœ]|\b[cdjlmnqst]['’]", re.I), "es": re.compile(r"[ñ¿¡áíóú]", re.I)}

#: Letters of other languages in Latin script, which the languages above don't have.
_FOREIGN = {"vi": "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "pl": "ąćęłńśźż", "cs": "ěřůčšžďťňý", "tr": "ğış", "ro": "șțşţ", "hu": "őű", "sv": "å", "da": "æø"}
_OTHER = {k: re.compile("[" + v + "]") for k, v in _FOREIGN.items()}

#: Names of languages in the languages that prompts are written in.
NAMES = {
    "en": "english englisch englische anglais anglaise inglés inglesa",
    "de": "german deutsch deutsche allemand allemande alemán alemana",
    "fr": "french französisch französische français française francés francesa",
    "es": "spanish spanisch spanische espagnol espagnole español española castellano",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués",
    "ru": "russian russisch russische russe ruso русский",
    "zh": "chinese chinesisch chinesische chinois chino 中文",
    "ja": "japanese japanisch japanische japonais japonés 日本語",
    "ar": "arabic arabisch arabische arabe árabe",
    "hi": "hindi",
    "th": "thai thailändisch thaï tailandés",
}
_NAMED = {n: k for k, v in NAMES.items() for n in v.split()}
_ASKED = re.compile(
    r"(?:\b(?:in|into|to|auf|ins|en|al|in the|vers l[ea'’]?|a la)\s+(?:the\s+|das\s+|el\s+|le\s+)?|\b(?:the|die|la|a|eine|une|una)\s+(?:versión\s+(?:en\s+)?|version\s+)?|\bversion\s+)"
    r"(" + "|".join(sorted(map(re.escape, _NAMED), key=len, reverse=True)) + r")\b", re.I
)
_LABEL = re.compile(r"^(?:question|prompt|task|instruction|user|q|frage|aufgabe|pregunta|tarea|consigne|text|texto|texte)\s*[:：]\s*", re.I)

#: Ways to decline a task, by language. Declining an invitation or describing what can't be done is no match.
_TASK = r"(?:help|assist|provide|answer|complete|respond|fulfil+|comply|do (?:this|that|so|it)\b|write (?:this|that|it)\b|produce|generate|discuss|continue|with (?:this|that))"
REFUSALS = {
    "en": rf"\b(?:can(?:['’]t|not| not)|could(?:n['’]t| not)|won['’]t|will not|(?:['’]m|am|be|was) (?:not able|unable) to|won['’]t be able to|not (?:able|allowed|permitted|comfortable) (?:to|with)|decline to|refuse to|have no way to|(?:do not|don['’]t) have the ability to|not in a position to)\s+(?:\w+ ){{0,2}}{_TASK}"
    r"|\b(?:must|have to|need to) (?:decline|refuse|pass on)|\b(?:do not|don['’]t) feel comfortable|leave (?:this |it )?unanswered|\bas an? (?:ai|language model|assistant)\b[^.]{0,60}\b(?:not|no|n['’]t|unable)\b|against my (?:guidelines|rules|policy|policies)|can['’]t do this one",
    "de": r"(?:dabei|hier(?:bei)?|damit)? ?kann ich (?:ihnen |dir |dabei |hierbei |leider )*nicht (?:weiter)?(?:helfen|beantworten|erfüllen|bearbeiten|schreiben)|(?:anfrage|aufgabe|bitte) (?:muss|möchte) ich (?:leider )?ablehnen|ich muss (?:das|dies|diese \w+) ablehnen|als (?:ki|sprachmodell)\b[^.]{0,60}\bnicht\b|nicht möglich, (?:das|dies|darauf) zu|gegen meine (?:richtlinien|regeln)|(?:ich )?nicht in der lage, (?:das|dies|diese)",
    "fr": r"je ne (?:peux|suis|puis|saurais) (?:malheureusement )?pas (?:en mesure (?:de|d['’]) ?)?(?:vous aider|t['’]aider|répondre|faire (?:cela|ça)|écrire (?:cela|ça)|traiter|accomplir|fournir)|je dois (?:refuser|décliner)|impossible de (?:vous aider|répondre|traiter|faire)|en tant (?:que modèle|qu['’]ia|qu['’]assistant)[^.]{0,60}\b(?:ne|pas)\b|contre mes (?:règles|directives|principes)",
    "es": r"no (?:puedo|podré|soy capaz de|me es posible) (?:ayudar|responder|hacer (?:esto|eso)|escribir (?:esto|eso)|completar|atender|proporcionar|cumplir)|(?:debo|tengo que) (?:rechazar|negarme|declinar)|imposible (?:responder|ayudar|atender)|como (?:modelo de lenguaje|ia|asistente)[^.]{0,60}\bno\b|contra de mis (?:normas|reglas|directrices)",
    "it": r"non posso (?:aiutar|rispondere|farlo|completare)|devo rifiutare|come modello linguistico",
    "pt": r"não posso (?:ajudar|responder|fazer isso)|devo recusar|como modelo de linguagem",
    "ru": r"не (?:могу|смогу|буду|стану|хочу|вправе|готов[а]?) [^.!?]{0,30}(?:помо|отве|выполн|сдела|написа|обсужд)|предпоч\w+ не отвеча|вынужден[а]? отказать|отказываюсь|как языковая модель",
    "zh": r"(?:无法|不能|没办法|不便|不方便)(?:为[你您])?(?:回答|帮助|协助|完成|提供|帮)|帮不了(?:你|您)|我(?:做|办)不到|恕(?:我)?(?:不|无法|难以)|作为(?:一个)?(?:人工智能|语言模型|AI)[^。]{0,30}(?:不|无法)|拒绝(?:回答|完成)",
    "ja": r"(?:お答え|お手伝い|対応|回答)(?:することは)?(?:でき(?:ません|かねます)|いたしかねます)|言語モデルとして",
    "ar": r"لا (?:أستطيع|يمكنني|أقدر على) (?:مساعد|الإجابة|تنفيذ|المساعدة)|كنموذج لغوي|أعتذر عن",
    "hi": r"(?:मदद|उत्तर|जवाब)[^।]{0,20}नहीं (?:कर|दे) सकत|भाषा मॉडल के रूप में",
    "th": r"ไม่สามารถ(?:ช่วย|ตอบ|ทำ)|ในฐานะโมเดลภาษา",
}
_REFUSE = re.compile("|".join(REFUSALS.values()), re.I)
_GREETING = re.compile(r"^(?:hi|hello|dear|hey|hallo|liebe[r]?|guten \w+|bonjour|salut|chère?|cher|hola|querid[oa]|estimad[oa])\b[^\n]{0,40},\s*\n", re.I)
#: Closings of a letter, after which a name may end the text.
CLOSINGS = re.compile(
    r"^(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|thanks)|thank you|thanks|cheers|see you \w+|sincerely|yours \w+|best|viele grüße|liebe grüße|beste grüße|mit freundlichen grüßen|herzliche grüße|danke\b.*|gruß|bis bald|cordialement|bien à (?:toi|vous)|amicalement|à bientôt|merci\b.*|un saludo|saludos|gracias\b.*|atentamente|un abrazo|hasta pronto)\s*[,!.]?$",
    re.I,
)
_TERMINAL = re.compile(r"(?:[.!?…。！？।؟۔]|\.\.\.)[\"'”’»«“)\]」』*_`]*$|```\s*$|[\"”»」』)]$")
_HANGING = re.compile(r"(?:[,;:،、，：；(\[{«„“‘/&+=–—-]|\b\w+-)$")


def answer_of(raw: str | None) -> str:
    """The answer without reasoning and outer blanks."""
    return _THINK.sub("", raw).strip() if raw else ""


def has_content(text: str) -> bool:
    return any(c.isalnum() for c in text)


def language(text: str) -> str | None:
    """The language of a text by script, everyday words and letters; null where nothing tells."""
    letters = sum(c.isalpha() for c in text)
    if not letters:
        return None
    kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
    if kana + han >= 0.3 * letters:
        return "ja" if kana * 10 >= han else "zh"
    for lang, pattern in _SCRIPT.items():
        if len(pattern.findall(text)) >= 0.4 * letters:
            return lang
    lower = text.lower()
    for lang, pattern in _OTHER.items():
        if len(pattern.findall(lower)) >= max(1, 0.02 * letters):
            return lang
    score: Counter = Counter()
    for w in re.findall(r"[^\W\d_]+", lower):
        for lang in _STOP.get(w, ()):
            score[lang] += 1 if len(_STOP[w]) == 1 else 0.4
    for lang, pattern in _MARKS.items():
        score[lang] += 0.7 * len(pattern.findall(text))
    if not score:
        return None
    (best, n), *rest = score.most_common(2)
    return best if n >= 1 and (not rest or n > 1.25 * rest[0][1]) else None


def parts(prompt: str) -> tuple[str, str]:
    """(instruction, handed-over text) of a prompt."""
    head, mark, tail = prompt.partition("\n\n")
    if mark and tail.strip():
        return head, _LABEL.sub("", tail.strip())
    m = re.search(r"[:：]\s+", prompt)
    if m and m.end() < len(prompt):
        return prompt[: m.start()], prompt[m.end() :].strip()
    return prompt, ""


def expected_language(prompt: str) -> str | None:
    head, tail = parts(prompt)
    m = _ASKED.search(head)
    if m:
        return _NAMED[m.group(1).lower()]
    return language(prompt if not tail else head + "\n" + tail) or language(head)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _common(a: list[str], b: list[str]) -> int:
    """The longest common subsequence, bit-parallel."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = where.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _gives_back(want: list[str], got: list[str]) -> bool:
    """Whether ``got`` is the words of a source, once or over and over, with nothing new but slips."""
    if len(want) < 3:
        return False
    known = set(want)
    if sum(w not in known for w in got) > max(1, 0.1 * len(got)):
        return False  # the common subsequence can't be long enough
    if abs(len(want) - len(got)) > 0.2 * max(len(want), len(got)) + 1:
        if len(got) < len(want):
            return False
        want = (want * (len(got) // len(want) + 1))[: len(got)]  # the last repetition may break off
    both = _common(want, got)
    if len(got) - both > max(1, 0.1 * len(got)) or len(want) - both > max(1, 0.15 * len(want)):
        return False
    new = [w for w in (Counter(got) - Counter(want)).elements() if not any(_near(w, x) for x in known)]
    return len(new) <= 0.05 * len(got) and not any(c.isdigit() for w in new for c in w)


def _is_copy(sources: list[list[str]], text: str) -> bool:
    bare = text.strip().strip("\"'“”«»„>*`").strip()
    starts = {bare, re.sub(r"^[^\n:：]{1,30}[:：]\s*", "", bare)}  # with and without a label in front
    readings = [got for got in map(words_of, starts) if got]
    return any(_gives_back(want, got) for want in sources for got in readings)


def copied(prompt: str, answer: str) -> bool:
    """Whether the answer is the prompt, its instruction or its text again, with nothing new.

    It may hold them several times: as one run of words, or line by line, where every line or run of lines
    must be a copy.
    """
    head, tail = parts(prompt)
    sources = [words_of(s) for s in (prompt, tail, head)]
    if _is_copy(sources, answer):
        return True
    lines = [x for x in answer.split("\n") if has_content(x)]
    if len(lines) < 2:
        return False
    sizes = [len(words_of(x)) for x in lines]
    longest = 1.25 * max(map(len, sources)) + 2 + 15  # (a label has at most 15 words)
    reached = {0}  # all lines before these are copies
    for i in range(len(lines)):
        j, size = i + 1, sizes[i]
        while i in reached and j <= len(lines):
            if _is_copy(sources, "\n".join(lines[i:j])):
                reached.add(j)
            size += sizes[j] if j < len(lines) else 0
            j += 1
            if size > longest:
                break
    return len(lines) in reached


def _near(a: str, b: str) -> bool:
    """Words that differ by a slip: the same letters or one letter more, less or other."""
    if a == b or re.sub(r"(.)\1", r"\1", a) == re.sub(r"(.)\1", r"\1", b):
        return True
    if sorted(a) == sorted(b):
        return not a.isdigit()
    if min(len(a), len(b)) < 2 or abs(len(a) - len(b)) > 1 or any(c.isdigit() for c in a):
        return False
    return _common([*a], [*b]) >= max(len(a), len(b)) - 1


#: A greeting that names nobody: the answerer speaks.
_UNNAMED = re.compile(r"^(?:hi|hello|hey|hallo|guten (?:tag|morgen|abend)|bonjour|salut|hola)(?: there)?,\s*\n", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?…؟۔])\s+|(?<=[。！？।])|\n+")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」")
#: How talk about declining is built, by language: who speaks, what declines, what is declined, and the words around it.
_TALK = {
    "en": (
        "i me my myself we us our i'm i’m i'd i’d i've i’ve",
        "not no never cannot can't can’t won't won’t don't don’t doesn't doesn’t isn't isn’t couldn't couldn’t wouldn't wouldn’t shouldn't shouldn’t aren't aren’t unable impossible declin* refus* avoid* refrain* pass* prevent* prohibit* forbid* restrict* against outside beyond inappropriate unanswered skip* reject*",
        "answer* respond* response* repl* help* assist* request* question* task* topic* subject* matter* instruction* guideline* polic* rule* do doing write writing provid* discuss* fulfil* compl* continu* produc* generat* perform* handl* allow* permit* able comfortable appropriate position possible scope",
        "that's that’s it's it’s sorry apolog* unfortunately regret* thank* ask* appreciat* afraid but however to with the a an of for is are be am have has had been was were what which it this that these those here there one your you in on and or so do does can could would should will may might must need* want* given giv* mak* fall* under something anything someone else feel* from as language model ai assistant at by time right now such any kind way rather prefer* hope understand please any leave* sort thing things go goes consider* decid* cannot just simply",
    ),
    "de": (
        "ich mir mich mein* wir uns unser*",
        "nicht kein* nie ablehn* lehne verweiger* unmöglich außerhalb gegen verbiet* verbot* untersag* vermeid* lieber unangemessen",
        "antwort* beantwort* helf* hilfe weiterhelf* anfrage* aufgabe* frage* thema themen richtlinien regeln vorgaben anweisung* erfüll* mach* tun tue schreib* bearbeit* erlaub* darf dürf* möglich angemessen",
        "leider tut leid entschuld* danke dank für die der den dem das dies* ein* aber jedoch doch kann könn* möcht* will würd* muss müss* bin ist sind wird werden wurde worden habe hat zu zum zur auf in im von mit als ki sprachmodell assistent es was worüber sie ihnen dir du euch und hier dabei damit dazu hierzu hierbei weiter gebeten lage an so etwas leisten geben gegeben liegt fällt unter bitte ab werde verstößt stelle andere daher zumindest gern* um",
    ),
    "fr": (
        "je j me m moi mon ma mes nous notre nos",
        "ne n pas non refus* déclin* impossible évit* hors contre interdi* empêch* préfèr* préfér* inapproprié* abst*",
        "répon* réponse* aide* aider demande* question* tâche* sujet* consigne* règle* directive* instruction* principe* faire fais ferai traiter écrire fournir satisfaire accomplir permis* permet* autoris* possible capable mesure approprié*",
        "désolé* pardon malheureusement regret* regrette merci mais cependant toutefois de d à au aux la le les l un une des en que qu qui quoi suis est sont peux peut puis saurai* dois ai a été être vous t te votre vos ta ton ia modèle langue langage assistant pour sur par il s se y c ce cet cette ces cela ça ceci plutôt donné* donner posez autre là quelque chose et vais va tant",
    ),
    "es": (
        "yo me mi mis mí nosotros nos puedo podré voy debo soy tengo estoy prefiero lamento quiero",
        "no ni nunca rechaz* neg* declin* imposible evit* fuera contra prohib* imped* impid* prefier* inapropiad* absten*",
        "respond* respuesta* ayud* petici* solicitud* pregunta* tarea* tema* norma* regla* directri* instruccion* hacer hago haré escribir cumplir atender permit* permiso posible capaz apropiad*",
        "lo siento perdón disculp* lamentablemente gracias pero sin embargo por para con de del a al la el las los un una en que qué puede es está he ha sido ser usted te le su tu como ia modelo lenguaje asistente dar darse se eso esto esta este esa ese estas estos y o algo otra otro haz aquí así tipo mejor favor va",
    ),
}


def _matcher(words: str) -> re.Pattern:
    return re.compile("(?:" + "|".join(re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w) for w in words.split()) + r")\Z", re.I)


_TALKERS = {lang: tuple(map(_matcher, kinds)) for lang, kinds in _TALK.items()}


@lru_cache(maxsize=100_000)
def _kinds(lang: str, word: str) -> tuple[bool, bool, bool, bool]:
    """Whether a word speaks, declines, is what is declined, belongs to such talk at all."""
    who, no, what, around = (p.match(word) is not None for p in _TALKERS[lang])
    return who, no, what, who or no or what or around


def _declines(sentence: str) -> bool:
    """Whether a sentence declines and speaks of little but the request."""
    phrase = _REFUSE.search(sentence) is not None
    if not sentence.isascii() and not any("a" <= c <= "z" for c in sentence.lower()):
        return phrase  # other scripts: by phrase
    for lang in _TALKERS:
        words = _WHOLE.findall(sentence) if lang in ("en", "de") else _PARTS.findall(sentence)
        if not words:
            continue
        kinds = [_kinds(lang, w) for w in words]
        known = sum(k[3] for k in kinds)
        if phrase and known >= 0.7 * len(words):
            return True
        if known < len(words) - (len(words) > 6):
            continue
        if any(k[1] for k in kinds) and any(k[2] for k in kinds) and (any(k[0] for k in kinds) or any(_ASKING.match(w) for w in words) and not _ADDRESSED.match(words[0])):
            return len(words) >= 4
    return False


_WHOLE, _PARTS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?"), re.compile(r"[^\W_]+")
#: The exchange itself as the subject of a sentence.
_ADDRESSED = re.compile(r"(?:you|your|du|sie|ihr|vous|tu|votre|usted|ustedes)\Z", re.I)
_ASKING = re.compile(r"(?:answer|request|response|question|anfrage|antwort|frage|réponse|demande|respuesta|petición|solicitud)", re.I)


def refused(answer: str) -> bool:
    """Whether one of the first three sentences outside quotations declines the task (later on, such words
    belong to the text). A letter to somebody named is what was asked for."""
    if _GREETING.match(answer):
        if not _UNNAMED.match(answer) or any(CLOSINGS.match(x.strip()) for x in answer.split("\n")):
            return False
        answer = _UNNAMED.sub("", answer).strip()
    opening = [x for x in _SENTENCE_END.split(answer) if has_content(x)][:3]
    return any(_declines(_QUOTED.sub(" ", x)) for x in opening)


_TOKEN = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|\w+(?:[.'’-]\w+)*|\n\s*(?:[-*•–]|\d+[.)])?[ \t]*|[^\w\s]")


def tokens(text: str) -> list[tuple[str, str]]:
    """Words without case, numbers as 0, names with underscores as _, marks, and line starts as one token,
    each beside its kind: ^ for a word in capitals that does not open a sentence."""
    out, last = [], "\n"
    for t in _TOKEN.findall(text):
        kind = ""
        if t[0] == "\n":
            t = "\n"
        elif "_" in t:
            t = "_" if "." not in t else "_." + t.rsplit(".", 1)[1]
        elif any(c.isdigit() for c in t):
            t = re.sub(r"\d+", "0", t.lower())
        else:
            kind = "^" if t[:1].isupper() and last not in _ENDS else ""
            t = t.lower()
        out.append((t, kind or t))
        last = t
    return out


_ENDS = frozenset(". ! ? … 。 ！ ？ । ؟ ۔ \n".split(" "))


def contexts(toks: list[tuple[str, str]], i: int) -> list[str]:
    """The last four to two tokens before position i as they are and by kind, the longest first; the last one at the end."""
    out = []
    for k in (4, 3, 2):
        lead = str(k) if i >= k else f"{k}<"
        part = toks[max(0, i - k) : i]
        out.append(lead + "\x1f" + "\x1f".join([w for w, _ in part]))
        out.append(lead + "\x1e" + "\x1e".join([m for _, m in part]))
    out.append("1\x1f" + toks[i - 1][0])
    return out


_LIST_MARK = re.compile(r"^\s*(\d+)[.)]\s", re.M)


def _bare_number(text: str) -> bool | None:
    """Of an ending without a letter since the last sentence: False, a number is an answer; True where it would be
    the next mark of a numbered list; None of other endings."""
    tail = re.split(r"[.!?…。！？।؟۔\n\"”»]", text)[-1].strip()
    if not tail or any(c.isalpha() for c in tail):
        return None
    marks = _LIST_MARK.findall(text)
    return bool(marks) and tail.isdigit() and int(tail) == int(marks[-1]) + 1


def abrupt(text: str) -> bool | None:
    """True or False where the ending itself tells, None where the counts must."""
    if text.count("```") % 2:
        return True
    if _HANGING.search(text):
        return True
    if _TERMINAL.search(text):
        return False
    return _bare_number(text)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, str | None] = {}
    for b in batches:
        ids, defects, ends, last = [], [], [], []
        for i, prompt, raw in zip(*(b.column(j).to_pylist() for j in range(3))):
            text, found, open_end, ctx = answer_of(raw), [], False, None
            if not has_content(text):
                found.append("empty")
            else:
                if prompt and copied(prompt, text):
                    found.append("copied_question")
                if refused(text):
                    found.append("refusal")
                if prompt:
                    if prompt not in cache:
                        if len(cache) > 50_000:
                            cache.clear()
                        cache[prompt] = expected_language(prompt)
                    got = language(text)
                    if got and cache[prompt] and got != cache[prompt]:
                        found.append("wrong_language")
                hangs = abrupt(text)
                if hangs:
                    found.append("truncated")
                elif hangs is None:
                    lines = [x.strip() for x in text.split("\n") if x.strip()]
                    if not (len(lines) > 1 and CLOSINGS.match(lines[-2]) and len(lines[-1].split()) <= 3):
                        toks = tokens(text)  # (a name after a closing ends a letter)
                        open_end, ctx = True, contexts(toks, len(toks))
            ids.append(i)
            defects.append(found)
            ends.append(open_end)
            last.append(ctx)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(defects, pa.list_(pa.string())), pa.array(ends, pa.bool_()), pa.array(last, pa.list_(pa.string()))],
            names=["row_id", "defects", "open_end", "last"],
        )


#: Contexts that no ending asks about are sifted out where they are counted, by a filter of this many bits.
SIEVE = 1 << 22


def _counts(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    def out(n: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())],
            names=["ctx", "ended", "went_on"],
        )

    asked = np.unpackbits(sieve.view(np.uint8), bitorder="little").tobytes()

    def marked(c: str) -> int:
        return asked[crc32(c.encode("utf-8", "surrogatepass")) & (SIEVE - 1)]

    seen: dict[str, list[int]] = {}
    ends: dict[str, int] = {}
    for b in batches:
        for raw in b.column(0).to_pylist():
            toks = tokens(answer_of(raw))
            for i in range(1, len(toks)):
                if toks[i - 1][0] in _ENDS:
                    continue
                side = 0 if toks[i][0] in _ENDS else 1
                last = toks[i - 1][0]
                word = "1\x1f" + last
                seen.setdefault(word, [0, 0])[side] += 1
                wanted = ends.get(last)
                if wanted is None:
                    wanted = ends[last] = marked(word)
                if wanted:  # (an ending asks for its last word too)
                    for c in contexts(toks, i)[:-1]:
                        if marked(c):
                            seen.setdefault(c, [0, 0])[side] += 1
            if len(ends) > 200_000:
                ends = {}
            if len(seen) > 200_000:
                yield out(seen)
                seen = {}
    yield out(seen)


#: A context needs this many occurrences to be trusted; the last words end a sentence at least this often.
SUPPORT, ENDS_AT_LEAST = 3, 0.08
#: A last word without another occurrence tells of a cut where fewer words than this occur once only. (About one
#: in 25 answers breaks off, half of them inside a word: at 0.02 both explanations are as likely.)
UNSEEN = 0.02
#: Words that need another one behind them, for endings that nothing is known of.
NEEDS_MORE = set(
    "the a an of to and or but with for from in on at by because that which who is are was were be been has have had will would can could should must if when while as than into about after before until without over under between"
    " der die das den dem des ein eine einen einem einer und oder aber mit für von zu zum zur auf in im an am bei nach aus über unter weil dass wenn als ist sind war waren wird werden hat haben"
    " le la les un une des du de et ou mais avec pour par sur dans en au aux que qui dont car parce si quand comme est sont était a ont sera"
    " el los las una unos y o pero con para por sobre en del al que quien porque si cuando como es son era ha han será".split()
)


def defects(df: DataFrame, prompt: str, answer: str) -> DataFrame:
    """``row_id, defects`` (all triggered types, in order) and ``defect`` (the first) of every bad row."""
    src = df.where(F.col("row_id").isNotNull()).select("row_id", F.col(prompt).alias("p"), F.col(answer).alias("a")).dropDuplicates(["row_id"])
    src = cut(src)
    judged = cut(src.mapInArrow(_classify, "row_id long, defects array<string>, open_end boolean, last array<string>"))
    asked = judged.where("open_end").select("row_id", F.posexplode("last").alias("k", "ctx"))
    slot = F.crc32(F.encode("ctx", "utf-8")).bitwiseAND(F.lit(SIEVE - 1))
    bits = asked.select(F.shiftright(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    sieve = np.zeros(SIEVE // 64, np.int64)
    for w, b in bits.groupBy("w").agg(F.bit_or("b")).collect():  # at most SIEVE / 64 numbers, whatever the input
        sieve[w] = b
    shared = df.sparkSession.sparkContext.broadcast(sieve)
    counts = src.select("a").mapInArrow(lambda it: _counts(it, shared.value), "ctx string, ended long, went_on long")
    totals = cut(counts.groupBy("ctx").agg(F.sum("ended").alias("e"), F.sum("went_on").alias("c")))
    words = totals.where(F.col("ctx").startswith("1\x1f")).agg(F.sum((F.col("e") + F.col("c") == 1).cast("long")), F.sum(F.col("e") + F.col("c"))).first()
    rare = (words[0] or 0) < UNSEEN * (words[1] or 0)
    known = spread_join(asked, totals, "ctx", "left").withColumn("n", F.coalesce(F.col("e") + F.col("c"), F.lit(0)))
    is_word = F.col("ctx").startswith("1\x1f")
    trusted = (F.col("n") >= SUPPORT) & (F.col("ctx") != "1\x1f0")  # (what follows numbers in general tells nothing)
    verdict = known.groupBy("row_id").agg(
        F.max(F.when(is_word, F.col("n"))).alias("w"),
        F.max(F.when(is_word, F.substring_index("ctx", "\x1f", -1).isin(*sorted(NEEDS_MORE)))).alias("hangs"),
        F.min(F.when(trusted, F.struct("k", (F.col("e") / F.col("n")).alias("p"))))["p"].alias("p"),
    )
    cut_off = F.when((F.col("w") == 0) & F.lit(rare), F.lit(True)).when(F.col("p").isNotNull(), F.col("p") < ENDS_AT_LEAST).otherwise(F.col("hangs"))
    ends = verdict.where(cut_off).select("row_id", F.lit(True).alias("__cut"))
    all_types = judged.join(ends, "row_id", "left").select(
        "row_id", F.when(F.col("__cut"), F.array_append("defects", F.lit("truncated"))).otherwise(F.col("defects")).alias("defects")
    )
    return all_types.where(F.size("defects") > 0).withColumn("defect", F.col("defects")[0])
