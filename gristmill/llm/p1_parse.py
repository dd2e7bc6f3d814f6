"""Source files that do not parse: packrat grammars for Python, JavaScript, JSON and TOML.

``parse_check`` adds nothing to a file but a verdict: whether its whole text is consumed by its language's
grammar, the position of the furthest failure (code points of the raw text) and a cause.

Defined results: a null text or a path without a known extension has no verdict (no row comes out); an
empty or blank text is a valid Python, JavaScript or TOML file and an invalid JSON file; the export's tag
line on top (``<reponame>…``) is not part of the file; texts of any length are read whole; repeated rows
give repeated verdicts; nesting may be as deep as the file is long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lang_data, lang_javascript, lang_python

#: File name extensions by language.
EXTENSIONS = {"py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "json": "json", "toml": "toml"}
_TAGS = re.compile(r"(?:<(?:reponame|filename|gh_stars)>[^\n]*(?:\n|\Z))")
_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?)\r?$", re.M)
VERDICT = "language string, parses boolean, fail_pos long, cause string"
#: A worker keeps the verdicts of valid texts it has seen, by content, up to so many characters.
SEEN = 50_000_000


def language_of(path: Column) -> Column:
    """The language told by the extension of a path, else null. Case doesn't matter."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), ext) if pairs else F.lit(None)


def _python(text: str) -> tuple[bool, int, str]:
    ok, count, what = lang_python.parse(text)
    if ok:
        return True, 0, ""
    return False, -1 if count < 0 else lang_python.position(text, count), what


PARSERS = {"python": _python, "javascript": lang_javascript.parse, "json": lang_data.parse_json, "toml": lang_data.parse_toml}


def verdict(text: str, language: str) -> tuple[bool, int | None, str | None]:
    """(parses, position of the furthest failure, cause) of one file."""
    tag = _TAGS.match(text)
    skip = tag.end() if tag else 0
    body = text[skip:] if skip else text
    ok, far, what = PARSERS[language](body)
    if ok:
        return True, None, None
    at = skip + (len(body.rstrip()) if far < 0 else far)
    marks = [m.start() + skip for m in _CONFLICT.finditer(body)]
    if any(m - 200 <= at <= m + 200 for m in marks):
        return False, at, "merge_conflict"
    if far < 0 or at >= skip + len(body.rstrip()):
        return False, at, "truncated"
    for other, parse in PARSERS.items():
        if other != language and other != "toml" and parse(body)[0]:
            return False, at, f"looks_like_{other}"
    return False, at, "merge_conflict" if marks else f"bad_{what.replace(' ', '_')}"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, tuple] = {}
    held = 0
    for batch in batches:
        names = batch.schema.names
        out = []
        for text, lang in zip(batch.column(names.index("__text")).to_pylist(), batch.column(names.index("language")).to_pylist()):
            key = (lang, hash(text), len(text))
            got = seen.get(key)
            if got is None or got[0] != text:
                got = (text, *verdict(text, lang))
                if got[1] and held + len(text) <= SEEN:
                    seen[key] = got
                    held += len(text)
            out.append(got[1:])
        keep = [c for c in names if c != "__text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index(c)) for c in keep]
            + [pa.array([r[0] for r in out], pa.bool_()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
            names=[*keep, "parses", "fail_pos", "cause"],
        )


def parse_check(df: DataFrame, text: str | Column, language: Column, keep: list[Column]) -> DataFrame:
    """One verdict for each row with a text and a known language: the ``keep`` columns and ``VERDICT``."""
    src = df.select(*keep, language.alias("language"), (F.col(text) if isinstance(text, str) else text).alias("__text"))
    src = src.where(F.col("__text").isNotNull() & F.col("language").isin(*PARSERS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("__text").schema)
    return src.mapInArrow(_batches, f"{schema}, parses boolean, fail_pos long, cause string")


def rates(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Files, invalid files and the rate for each group (null groups count as a group)."""
    bad = F.sum(F.when(~F.col("parses"), 1).otherwise(0))
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("invalid_rate")
    )
