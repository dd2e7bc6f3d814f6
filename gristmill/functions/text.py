"""Column builders for normalising, measuring and labelling text. All stay in the JVM.

Null text gives null (measures: 0 unless stated). Patterns use ``(?U)`` where words and spaces are Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(t: Column | str, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(_c(t), F.lit(pattern), F.lit(to))


def count_of(t: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(_c(t), F.lit(pattern)), F.lit(0))


def has(t: Column | str, pattern: str) -> Column:
    return F.coalesce(_c(t).rlike(pattern), F.lit(False))


def any_of(t: Column | str, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_c(t).contains(n) for n in needles], F.lit(False))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x evaluated once, also inside the lambdas of higher-order functions."""
    return F.transform(F.array(x), use)[0]


# -- normalising -----------------------------------------------------------------------------------------
def strip(t: Column | str) -> Column:
    """Without outer Unicode white space."""
    return sub(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")


def newlines(t: Column | str) -> Column:
    return sub(t, r"\r\n?", "\n")


def pretrain_normal(t: Column | str) -> Column:
    """Line ends, zero-width marks, nulls and control characters."""
    return sub(newlines(t), "[​-‍﻿\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")


#: Typographic quotes and their ASCII forms.
QUOTES, ASCII_QUOTES = "“”„‟«»‘’‚‛", "\"\"\"\"\"\"''''"


def ascii_quotes(t: Column | str) -> Column:
    return F.translate(_c(t), QUOTES, ASCII_QUOTES)


def extract_normal(t: Column | str, quotes: bool = True, underscores: bool = True, leading_noise: bool = False) -> Column:
    """Extraction normaliser: controls, runs of blanks within lines, optional quotes, underscores, odd prefix."""
    x = sub(newlines(t), r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    x = ascii_quotes(x) if quotes else x
    x = strip(sub(sub(x, "[ \\t]+", " "), "(?mU)[\\s&&[^\\n]]+$"))
    x = strip(sub(x, "_{4,}", " ")) if underscores else x
    return sub(sub(x, "(?U)^\\s*[^\\w<>{}\\[\\]().,;:'\"/\\-\\n#|>]{1,32}\\s*"), "(?U)^\\s+") if leading_noise else x


def shard_normal(t: Column | str, leading_noise: bool = True, quotes: bool = True, underscores: str = "keep") -> Column:
    """Cleaner at packing time: edge newlines, a leading comment or declaration, quotes, underscores."""
    x = sub(t, r"^\n+|\n+$")
    x = sub(x, r"(?s)^\s*(?:<!--.*?-->|<\?xml.*?\?>|<!DOCTYPE.*?>)\s*") if leading_noise else x
    x = F.translate(x, "“”‘’", "\"\"''") if quotes else x
    return {"keep": x, "space": F.translate(x, "_", " "), "remove": F.translate(x, "_", "")}[underscores]


def minimal_normal(t: Column | str) -> Column:
    return sub(newlines(t), r"[\x00\x0b\x0c]")


def code_normal(t: Column | str) -> Column:
    return sub(sub(t, "^﻿+"), "\\x00")


def collapse(t: Column | str) -> Column:
    """All runs of white space become one space."""
    return strip(sub(t, r"(?U)\s+", " "))


def prose_normal(t: Column | str) -> Column:
    x = F.translate(_c(t), "“”‘’ ", "\"\"'' ")
    return strip(sub(sub(newlines(x), "[ \\t]+", " "), "\n{3,}", "\n\n"))


def code_keep_normal(t: Column | str) -> Column:
    """The indentation-preserving form for code."""
    return sub(newlines(t), "^\n+|(?U)\\s+$")


def prompt_key(t: Column | str) -> Column:
    return collapse(sub(F.lower(prose_normal(t)), "(?U)[^\\w\\s\"'-]", " "))


def hash_key(t: Column | str) -> Column:
    return sub(F.lower(strip(newlines(t))), r"(?U)\s+", " ")


def drop_prefix(t: Column | str) -> Column:
    return strip(sub(t, r"(?i)^\s*(?:user|instruction):\s*"))


def drop_reasoning(t: Column | str) -> Column:
    return sub(t, r"(?is)<think>.*?</think>\s*")


def strip_meta_lines(t: Column | str, most: int = 8) -> Column:
    """Without the block of up to ``most`` tag lines on top."""
    return sub(t, rf"^(?:<[^>\n]{{1,64}}>[^\n]*(?:\n|\z)){{1,{most}}}\n*")


def meta_line_count(t: Column | str, most: int = 8) -> Column:
    block = F.regexp_extract(_c(t), rf"^((?:<[^>\n]{{1,64}}>[^\n]*(?:\n|\z)){{1,{most}}})", 1)
    return F.when(F.coalesce(block, F.lit("")) == "", 0).otherwise(count_of(sub(block, "\n$"), "\n") + 1)


#: Headings that end an encyclopedia article's body.
WIKI_TAILS = ["See also", "References", "External links", "Further reading", "Notes", "Bibliography", "Sources"]


def trim_wiki_tail(t: Column | str) -> Column:
    cut = sub(t, r"(?is)\n\s*(?:" + "|".join(WIKI_TAILS) + r")\s*\n.*$", "\x00")
    return F.when(F.endswith(cut, F.lit("\x00")), sub(cut, "(?U)[\\s\\x00]+$")).otherwise(cut)


def halve_code(t: Column | str, most: int = 400, marker: str = "# ...") -> Column:
    """Head and tail of a text of more than ``most`` lines around a marker."""
    lines, half = F.split(_c(t), "\n"), most // 2
    tail = F.slice(lines, -half, half)
    return F.when(F.size(lines) > most, F.array_join(F.concat(F.slice(lines, 1, half), F.array(F.lit(marker)), tail), "\n")).otherwise(_c(t))


def number_key(t: Column | str) -> Column:
    """A numeric token without % and trailing zeros, to eight places; other text as it is."""
    raw = F.replace(strip(t), F.lit("%"), F.lit(""))
    return F.coalesce(sub(sub(F.format_string("%.8f", F.try_to_number(raw, F.lit("S999999999999.99999999")).cast("double")), "0+$"), "\\.$"), raw)


def answer_key(t: Column | str) -> Column:
    return F.replace(F.lower(strip(t)), F.lit(" "), F.lit(""))


def sha1(t: Column | str) -> Column:
    return F.sha1(_c(t))


def stable_id(prefix: str, *parts: Column, length: int = 10) -> Column:
    text = F.array_join(F.array(F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), "||")
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(text), 1, length))


def longest_quoted(t: Column | str) -> Column:
    """The longest text in straight or curly double quotes without outer and repeated blanks, the first of equals; else null."""
    found = F.regexp_extract_all(_c(t), F.lit('["“]([^"“”]+)["”]'), F.lit(1))
    plain = F.filter(F.transform(found, lambda x: collapse(x)), lambda x: x != "")
    return F.aggregate(plain, F.lit(None).cast("string"), lambda a, x: F.when(F.length(x) > F.coalesce(F.length(a), F.lit(0)), x).otherwise(a))


def after_colon(t: Column | str) -> Column:
    """What stands behind the first colon and a blank; null where nothing does."""
    return F.nullif(strip(F.regexp_extract(_c(t), r"(?s)^[^:]*:\s+(.*)$", 1)), F.lit(""))


def json_object(t: Column | str) -> Column:
    """The one JSON object of a text: the whole text, else from its first to its last brace; null where that is none."""
    def read(x: Column) -> Column:
        v = F.try_parse_json(x)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    return F.coalesce(read(_c(t)), read(F.regexp_extract(_c(t), r"(?s)\{.*\}", 0)))


def without_header(t: Column | str) -> Column:
    """Without one export line on top."""
    return sub(t, r"\A<reponame>[^\n]*(?:\n|\z)")


def open_prompt_reason(t: Column | str, banned: list[str], least: int = 6, most: int = 80) -> Column:
    """Why a prompt is not taken: banned parts (of words too), too few or too many words."""
    n = F.size(space_words(_c(t)))
    return F.when(any_of(F.lower(_c(t)), banned), "banned_keyword").when(n < least, "too_short").when(n > most, "too_long")


# -- measures --------------------------------------------------------------------------------------------
def _share(n: Column, t: Column | str, empty: float = 0.0) -> Column:
    size = F.length(_c(t))
    return F.when(size > 0, n / size).otherwise(F.lit(empty))


def ascii_ratio(t: Column | str, empty: float = 0.0) -> Column:
    return _share(F.length(sub(t, r"[^\x00-\x7F]")), t, empty)


def symbol_ratio(t: Column | str) -> Column:
    return _share(count_of(t, r"(?U)[^\p{L}\p{N}\s]"), t)


URL = r"(?i)https?://\S+|www\.\S+"


def url_density(t: Column | str) -> Column:
    return _share(count_of(t, URL), t)


def urls_per_thousand(t: Column | str) -> Column:
    return 1000 * _share(count_of(t, r"https?://\S+"), t)


def nonblank_lines(t: Column | str) -> Column:
    return F.filter(F.split(_c(t), "\n"), lambda x: strip(x) != "")


def short_line_ratio(t: Column | str, most: int = 30) -> Column:
    def share(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: F.length(strip(x)) <= most)) / F.size(lines)).otherwise(F.lit(0.0))

    return let(nonblank_lines(t), share)


HTML_TAG = r"(?i)</?(?:html|div|span|script|style|head|body|p|br|table|tr|td|ul|li|a)\b"


def html_score(t: Column | str) -> Column:
    return _share(count_of(t, r"<[^>]{1,200}>") + 0.5 * count_of(t, r"&[a-zA-Z]{2,10};"), t)


def html_heavy(t: Column | str, most: Column | float) -> Column:
    limit = most if isinstance(most, Column) else F.lit(most)
    return html_score(t) > F.when(has(t, HTML_TAG), limit * 0.5).otherwise(limit)


def placeholder_spam(t: Column | str) -> Column:
    return has(t, r"_{20}|\.{20}|-{30}|={30}|(.)\1{49}")


# (the words of a menu are fixed values)
def menu_hits(t: Column | str) -> Column:
    return count_of(t, r"(?i)\b(?:home|about|contact|privacy|terms|cookie|cookies|subscribe|sign in|login|register|newsletter)\b")


def first_line(t: Column | str) -> Column:
    return F.coalesce(strip(F.try_element_at(nonblank_lines(t), F.lit(1))), F.lit(""))


def head_label(t: Column | str) -> Column:
    x = first_line(t)
    return (
        F.when(x == "", "empty")
        .when(x.startswith("```"), "fence")
        .when(x.startswith("|"), "pipes_table")
        .when(has(x, r"^#{1,6}\s+\S"), "md_heading")
        .when(has(x, r"^-\s+\S"), "dash_list")
        .when(has(x, r"^\*\s+\S"), "star_list")
        .when(has(x, r"^>\s+\S"), "blockquote")
        .when(x.startswith("_"), "underscores")
        .when(has(x, r"^\p{Nd}"), "digit")
        .when(has(x, r"^\p{L}"), "alpha")
        .otherwise("other_symbol")
    )


def htmlish_head(t: Column | str) -> Column:
    x = first_line(t)
    return ~x.startswith("#include ") & x.startswith("<")


def markdownish(t: Column | str) -> Column:
    head = F.slice(F.split(_c(t), "\n"), 1, 60)
    headings = F.size(F.filter(head, lambda x: x.rlike(r"^\s*#{1,6}\s+\S")))
    return _c(t).contains("```") | (headings >= 2) | (count_of(F.array_join(head, "\n"), r"\|") >= 24)


#: Signs of code and signs against Python.
CODE_NEEDLES = ["def ", "class ", "import ", "from ", "#include", "#define", "public ", "private ", "protected ", "template<", "function ", "const ", "let ", "var ", "package ", "namespace ", "using ", "return ", "if ", "else", "elif ", "try", "except", "for ", "while ", "switch ", "case "]
NOT_PYTHON = ["using System", "namespace ", "public class", "private ", "protected ", "#include ", "BEGIN CERTIFICATE", "<!DOCTYPE html", "<html", "<?xml", "package ", "public static void main", "console.log(", "function(", "SELECT ", "CREATE TABLE", "echo ", "REM ", "setlocal", "::", "/*", "*/"]


def looks_like_code(t: Column | str) -> Column:
    x = _c(t)
    return (
        any_of(x, CODE_NEEDLES)
        | (x.contains("{") & x.contains("}"))
        | (x.contains(";") & x.contains("\n"))
        | ((count_of(x, "\n") >= 8) & (count_of(x, "[()]") >= 6))
    )


def guess_python(t: Column | str) -> Column:
    x = _c(t)

    def by_lines(head: Column) -> Column:
        indented = F.size(F.filter(head, lambda v: v.startswith("    ")))
        colons = F.size(F.filter(head, lambda v: v.rlike(r":\s*$")))
        return F.when(F.size(head) == 0, False).when((indented >= 6) & (colons >= 2), True).otherwise(count_of(x, "def |class |import |from |None|True|False") >= 2)

    return (
        F.when(has(x, r"^\s*#!/usr/bin/(?:env )?python") | has(x, r"(?m)^\s*def\s+\w+\s*\(|^\s*class\s+\w+\s*[:(]") | has(x, "if __name__ == (?:'__main__'|\"__main__\"):"), True)
        .when(any_of(x, NOT_PYTHON) | (count_of(x, "[{}]") > 8) | (count_of(x, ";") > 12), False)
        .otherwise(let(F.slice(nonblank_lines(x), 1, 200), by_lines))
    )


def python_signals(t: Column | str) -> Column:
    """How many of six signs of Python a text shows."""
    signs = [r"(?m)^\s*def\s+\w+\s*\(", r"(?m)^\s*class\s+\w+", r"(?m)^\s*(?:import|from)\s+\w+", r"(?m)^\s*(?:if|for|while|with|try|else|elif)\b.*:\s*$", r"\bself\b", "__name__"]
    return sum((has(t, s).cast("int") for s in signs), F.lit(0))


def code_line_ratio(t: Column | str) -> Column:
    def share(head: Column) -> Column:
        codey = F.filter(head, lambda v: strip(v).rlike(r"^#(?:!|include|define)|^#.{0,198}$|[;{}()=:]|->|^(?:def|class|import|from|return|fn|func) "))
        return F.when(F.size(head) > 0, F.size(codey) / F.size(head)).otherwise(F.lit(0.0))

    return let(F.slice(nonblank_lines(t), 1, 220), share)


def word_count(t: Column | str) -> Column:
    return count_of(t, r"(?U)\b[\w'-]+\b")


def sentence_count(t: Column | str) -> Column:
    """Rough count: after . ! ? and white space, and at line ends."""
    parts = F.split(prose_normal(t), r"(?U)(?<=[.!?])\s+|\n+")
    return F.size(F.filter(parts, lambda p: strip(p) != ""))


BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"


def line_count(t: Column | str) -> Column:
    return F.size(nonblank_lines(t))


def bullet_lines(t: Column | str) -> Column:
    return F.filter(F.split(_c(t), "\n"), lambda x: x.rlike(BULLET))


def bullet_count(t: Column | str) -> Column:
    return F.size(bullet_lines(t))


def numbered_count(t: Column | str) -> Column:
    return count_of(t, r"(?m)^\s*\d+[.)]\s+")


def code_block_count(t: Column | str) -> Column:
    return F.floor(count_of(t, "```") / 2)


def first_code_block(t: Column | str) -> Column:
    """The first fenced block, else null."""
    got = F.regexp_extract(_c(t), r"(?is)```(?:python)?\s*(.*?)```", 1)
    return F.when(has(t, r"(?is)```(?:python)?\s*.*?```"), got)


def first_number(t: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(_c(t), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(1)).try_cast("double")


def last_number(t: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(_c(t), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1)).try_cast("double")


def yes_no_unknown(t: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(t), r"(?i)\b(yes|no|unknown)\b", 1)), F.lit(""))


def prompt_echo(prompt: Column | str, answer: Column | str) -> Column:
    p, a = prompt_key(prompt), prompt_key(answer)
    return F.coalesce((p != "") & (a != "") & (a.contains(F.substring(p, 1, 80))), F.lit(False))


def has_greeting(t: Column | str) -> Column:
    return has(F.lower(first_line(t)), "^(?:dear |hello |hi )")


def has_signoff(t: Column | str) -> Column:
    lines = F.transform(nonblank_lines(t), lambda x: F.lower(strip(x)))
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), "\n")
    return any_of(tail, ["best regards", "best,", "kind regards", "sincerely", "thank you,", "best wishes"])


def words(t: Column | str) -> Column:
    return F.filter(F.split(prompt_key(t), " "), lambda w: w != "")


def shingles(t: Column | str, n: int = 3) -> Column:
    """The set of word n-grams; a shorter text is one shingle, null has none."""

    def runs(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(words(t), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two shingle sets."""

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        shared = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / (F.size(x) + F.size(y) - shared)).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("x"), b.alias("y")), of)


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """The share of a's different words that b has."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(_c(t)), F.lit("([a-z0-9']+)"), F.lit(1))) for t in (a, b))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def space_words(t: Column | str) -> Column:
    return F.filter(F.split(_c(t), r"(?U)\s+"), lambda w: w != "")


def distinct_trigrams(t: Column | str) -> Column:
    def share(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
        return F.when(F.size(w) < 4, F.lit(1.0)).otherwise(F.size(F.array_distinct(runs)) / (F.size(w) - 2))

    return let(space_words(t), share)


def length_score(t: Column | str, target: Column | float = 40.0) -> Column:
    goal = target if isinstance(target, Column) else F.lit(float(target))
    n = F.size(space_words(t))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.exp(-F.pow((n - goal) / F.greatest(goal, F.lit(1.0)), 2)))


def quality_flags(t: Column | str) -> dict[str, Column]:
    return {
        "indent4": has(t, r"(?m)^ {4}"),
        "blank_line": _c(t).contains("\n\n"),
        "html": has(t, HTML_TAG),
        "placeholder": has(t, "_{8}|\\.{8}"),
        "url": has(t, URL),
    }


# -- cascades --------------------------------------------------------------------------------------------
#: Thresholds by domain (ASCII share, tag share, URL density, short-line share, menu words).
PRESETS = {
    "web": (0.75, 0.020, 0.0025, 0.75, 4),
    "wiki": (0.80, 0.015, 0.0020, 0.80, 4),
    "cosmo": (0.75, 0.020, 0.0025, 0.80, 4),
    "story": (0.80, 0.020, 0.0030, 0.85, 4),
    "code": (0.0, 0.050, 0.0100, 0.90, 10),
}


def reject_reason(t: Column | str, domain: str = "web", min_chars: int = 200, max_chars: int = 50_000, drop_lt: bool = True) -> Column:
    """The first rule of the cleaning cascade that a cleaned text breaks; null where it is kept."""
    ascii_min, tags, urls, short, menu = PRESETS[domain]
    x = F.coalesce(_c(t), F.lit(""))
    chain = F.when(x == "", "empty")
    chain = chain.when(x.startswith("<") & F.lit(drop_lt), "startswith_lt")
    chain = chain.when(F.length(x) < min_chars, "too_short").when(F.length(x) > max_chars, "too_long")
    chain = chain.when(placeholder_spam(x), "placeholders").when(html_heavy(x, tags), "html_heavy")
    chain = chain.when(url_density(x) > urls, "url_spam")
    if domain in ("web", "wiki", "cosmo"):
        chain = chain.when((menu_hits(x) >= menu) & (short_line_ratio(x) >= short), "menu_spam")
    return chain.when(ascii_ratio(x) < ascii_min, "low_ascii") if ascii_min > 0 else chain


def generic_reason(t: Column | str, min_chars: int = 200, max_chars: int = 20_000, min_ascii: float = 0.92, max_symbols: float = 0.30) -> Column:
    x = F.coalesce(_c(t), F.lit(""))
    return (
        F.when(head_label(x).isin("pipes_table", "fence", "underscores"), "head_pattern")
        .when(ascii_ratio(F.substring(x, 1, 256), 1.0) < min_ascii, "head_ascii")
        .when(ascii_ratio(x, 1.0) < min_ascii, "ascii")
        .when(symbol_ratio(x) > max_symbols, "symbols")
        .when(F.length(x) < min_chars, "too_short")
        .when(F.length(x) > max_chars, "too_long")
    )


def wiki_reason(t: Column | str, min_paragraphs: int = 2) -> Column:
    x = F.coalesce(trim_wiki_tail(_c(t)), F.lit(""))
    paragraphs = F.size(F.filter(F.split(x, "\n\n"), lambda p: strip(p) != ""))
    return (
        F.when(x == "", "empty")
        .when(head_label(x).isin("pipes_table", "md_heading", "fence"), "head_pattern")
        .when(any_of(F.lower(x), ["creative commons", "licensed under", "copyright", "citation needed", "retrieved ", "isbn "]), "template")
        .when(count_of(x, "\n- ") >= 12, "list")
        .when(paragraphs < min_paragraphs, "few_paragraphs")
    )


def code_reason(t: Column | str, min_lines: int = 5, max_line: int = 400, min_ascii: float = 0.9, max_symbols: float = 0.45, min_code_lines: float = 0.3) -> Column:
    x = F.coalesce(_c(t), F.lit(""))
    longest = F.array_max(F.transform(F.split(x, "\n"), lambda v: F.length(v)))
    letters = _share(count_of(x, r"\p{L}"), x)
    return (
        F.when(strip(x) == "", "empty")
        .when(htmlish_head(x), "html_head")
        .when(line_count(x) < min_lines, "few_lines")
        .when(longest > max_line, "long_line")
        .when(ascii_ratio(x, 1.0) < min_ascii, "ascii")
        .when(symbol_ratio(x) > max_symbols, "symbols")
        .when(markdownish(x), "markdown")
        .when(~looks_like_code(x), "no_code")
        .when(code_line_ratio(x) < min_code_lines, "few_code_lines")
        .when(letters < 0.03, "few_letters")
    )


# -- answers ---------------------------------------------------------------------------------------------
def _reasons(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def numbered_list(t: Column | str) -> Column:
    return has(t, r"(?m)^\s*\d+\.\s+")


def body_sentences(t: Column | str) -> Column:
    """Sentences without the first and last of at least three lines (greeting and sign-off)."""
    lines = F.transform(nonblank_lines(t), lambda x: strip(x))
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return sentence_count(F.when(F.size(lines) < 3, _c(t)).otherwise(body))


#: Terms of which two make an explanation too technical.
TECHNICAL = ["financial statement", "cash flow", "income statement", "liabilities", "equity", "algorithm", "implementation", "framework", "optimization"]


def too_technical(t: Column | str) -> Column:
    low = F.lower(_c(t))
    return sum((low.contains(w).cast("int") for w in TECHNICAL), F.lit(0)) >= 2


def placeholder(t: Column | str) -> Column:
    return has(t, r"(?i)\[(?:your|insert|name|date)[^\]]*\]|\blorem ipsum\b|\btbd\b")


def code_pollution(t: Column | str) -> Column:
    return has(t, r"(?i)```|\bimport\s+\w+|\bfrom\s+\w+\s+import\b|\bdef\s+\w+\s*\(|\bclass\s+\w+|\bprint\s*\(")


def hard_reasons(answer: Column | str, prompt: Column | str) -> Column:
    """All general reasons to fail an answer."""
    a = F.coalesce(_c(answer), F.lit(""))
    return _reasons(
        [
            ("empty", strip(a) == ""),
            ("too_short", word_count(a) < 2),
            ("code_pollution", code_pollution(a)),
            ("placeholder", placeholder(a)),
            ("meta_prefix", has(a, r"(?i)^\s*(?:sure|certainly|of course|here(?:'s| is| are))\b")),
            ("multiple_answers", has(a, r"(?i)\b(?:option|version|alternative)\s*[12]\b")),
            ("prompt_echo", prompt_echo(prompt, a)),
            ("meta_ai", F.lower(a).contains("as an ai")),
        ]
    )


def family_reasons(answer: Column | str, family: Column, limits: Column) -> Column:
    """Reasons by family: mails, rewritten sentences, bulleted summaries, explanations."""
    a = F.coalesce(_c(answer), F.lit(""))
    n, s = word_count(a), sentence_count(a)

    def lim(name: str, default: Column | int) -> Column:
        return F.coalesce(limits[name], F.lit(default) if isinstance(default, int) else default)

    mail = F.coalesce(limits["must_be_email"], F.lit(False))
    short = ~mail & F.coalesce(limits["must_be_short_message"], F.lit(False))
    body, least, most = body_sentences(a), lim("min_sentences", 1), lim("max_sentences", 7)
    email = _reasons(
        [
            ("email_or_message_length", (n < lim("min_words", F.when(mail, 25).otherwise(5))) | (n > lim("max_words", F.when(mail, 125).otherwise(55)))),
            ("email_or_message_has_bullets", bullet_count(a) > 0),
            ("missing_greeting", mail & ~has_greeting(a)),
            ("missing_signoff", mail & ~has_signoff(a)),
            ("email_body_sentence_count", mail & ((body < least) | (body > most))),
            ("short_message_sentence_count", short & ((s < least) | (s > most))),
            ("short_message_too_many_lines", short & (line_count(a) > 4)),
        ]
    )
    rewrite = _reasons([("rewrite_multi_paragraph", line_count(a) > 3), ("rewrite_too_many_sentences", s > lim("max_sentences", 2)), ("rewrite_too_long", n > lim("max_words", 35)), ("rewrite_became_email", has_greeting(a) & has_signoff(a))])
    exact = limits["exact_bullets"]
    summary = _reasons(
        [
            ("wrong_bullet_count", exact.isNotNull() & (bullet_count(a) != exact)),
            ("extra_non_bullet_text", exact.isNotNull() & (line_count(a) > bullet_count(a))),
            ("bullet_too_long", exact.isNotNull() & F.exists(bullet_lines(a), lambda b: word_count(sub(b, BULLET)) > 20)),
            ("summary_not_one_sentence", exact.isNull() & (s != 1)),
            ("summary_sentence_too_long", exact.isNull() & (n > lim("max_words", 35))),
        ]
    )
    explain = _reasons([("explain_sentence_count", (s < 1) | (s > lim("max_sentences", 3))), ("explain_too_long", n > lim("max_words", 80)), ("explain_list_format", (bullet_count(a) > 0) | numbered_list(a)), ("too_technical", too_technical(a))])
    none = F.array().cast("array<string>")
    return F.when(family.startswith("email"), email).when(family.startswith("rewrite"), rewrite).when(family.startswith("summary"), summary).when(family.startswith("explain"), explain).otherwise(none)


#: Reasons that no repair mends.
HARD = ["code_pollution", "placeholder", "prompt_echo", "multiple_answers", "meta_ai"]


def repairable(reasons: Column) -> Column:
    return ~F.arrays_overlap(reasons, F.array(*[F.lit(h) for h in HARD]))


def instruction_score(reasons: Column) -> Column:
    return F.greatest(F.lit(1), 5 - F.size(reasons))


#: Words up to which an answer is brief (5) or not long (4), by family; others get at most 4.
BRIEF = {"rewrite_style": (30, 40), "summary_bullets": (70, 90), "explain_compare": (70, 90), "email_message": (100, 125)}


def brevity_score(answer: Column | str, family: Column) -> Column:
    n = word_count(answer)
    out = F.when(n <= 90, 4).otherwise(2)
    for name, (top, mid) in BRIEF.items():
        out = F.when(family == name, F.when(n <= top, 5).when(n <= mid, 4).otherwise(2)).otherwise(out)
    return out


def cleanliness_score(reasons: Column) -> Column:
    return F.greatest(F.lit(1), 5 - F.size(reasons))


def naturalness_score(answer: Column | str) -> Column:
    return F.when(placeholder(answer) | code_pollution(answer), 1).otherwise(4)


#: Words that tell a prompt's family, in order.
FAMILIES = {
    "rewrite_style": ["rewrite", "rephrase", "paraphrase", "make this sound", "make it sound", "more formal", "more concise", "more polite", "clearer", "shorter", "more direct", "improve the wording", "professional tone", "change the tone", "edit this sentence", "polish this sentence", "simplify this sentence"],
    "summary_bullets": ["summarize", "summary", "tl;dr", "tldr", "bullet points", "key takeaways", "main points", "main ideas", "one sentence summary", "extract key points", "condense this", "short summary", "brief summary"],
    "email_message": ["email", "follow up", "follow-up", "reschedule", "thank you", "thank-you", "confirm receipt", "professional message", "polite message", "write a message", "draft a note", "write a note", "ask a colleague", "ask politely", "request a meeting", "schedule a meeting"],
    "explain_compare": ["explain", "what is", "what are", "difference between", "simple terms", "plain language", "everyday language", "describe", "define"],
}


def family_of(prompt: Column | str) -> Column:
    low = F.lower(_c(prompt))
    out = None
    for name, needles in FAMILIES.items():
        out = F.when(any_of(low, needles), name) if out is None else out.when(any_of(low, needles), name)
    return out
