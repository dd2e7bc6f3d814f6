"""Queries over the general operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, one_delivery, spread_join, table
from ..functions import text as T
from ..functions import verify
from ..functions.tokens import with_token_count
from ..operators import chat, rows, tokens

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", *more)


def clean(t: str = "text"):  # noqa: ANN201
    return T.strip(T.pretrain_normal(t))


# SQL pieces: the same steps in the other engine's dialect
_WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
_NORM = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_DOCS = f"(SELECT doc_id AS row_id, source, lower(trim(lang)) AS lang, {_strip(_NORM)} AS t FROM documents WHERE text IS NOT NULL)"
_LINES = "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{Z}]'))"
_MIX = "(SELECT row_id, list_transform(list_filter(messages, lambda m: lower(m.role) IN ('system','user','assistant') AND regexp_matches(m.content, '[^\\s\\p{Z}]')), lambda m: {'role': lower(m.role), 'content': regexp_replace(m.content, '\\r\\n?', chr(10), 'g')}) AS m, meta FROM sft_mix QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"
_ANS = "(SELECT row_id, prompt, family, subfamily, coalesce(regexp_replace(answer_raw, '(?is)<think>.*?</think>\\s*', '', 'g'), '') AS a FROM teacher_answers QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"


def mix_turns(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(table(spark, d, "sft_mix")).select("row_id", chat.lenient(F.col("messages")).alias("m"), "meta")


def answers(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(table(spark, d, "teacher_answers")).select("row_id", "prompt", "family", "subfamily", F.coalesce(T.drop_reasoning("answer_raw"), F.lit("")).alias("a"))


# -- cleaning --------------------------------------------------------------------------------------------
@query(f"SELECT row_id, length(t) AS chars, sha1(t) AS digest FROM {_DOCS}")
def clean_normalize(spark, d):
    t = docs(spark, d).where("text IS NOT NULL").withColumn("t", clean())
    return t.select("row_id", F.length("t").cast("long").alias("chars"), T.sha1("t").alias("digest"))


_SHORT = f"coalesce(len(list_filter({_LINES}, lambda x: length({_strip('x')}) <= 30)) / nullif(len({_LINES}), 0)::DOUBLE, 0)"
_ASCII = r"(CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / length(t)::DOUBLE ELSE 0 END)"
_TAGS = f"(({_n('t', '<[^>]{1,200}>')} + 0.5 * {_n('t', '&[a-zA-Z]{2,10};')}) / greatest(length(t), 1))"
_TAGGED = r"regexp_matches(t, '(?i)</?(html|div|span|script|style|head|body|p|br|table|tr|td|ul|li|a)\b')"
_RUNS = "regexp_matches(t, '_{20}|\\.{20}|-{30}|={30}')"
_URLS = f"({_n('t', '(?i)https?://\\S+|www\\.\\S+')} / greatest(length(t), 1)::DOUBLE)"
_MENU = f"({_n('t', '(?i)\\b(?:home|about|contact|privacy|terms|cookie|cookies|subscribe|sign in|login|register|newsletter)\\b')} >= 4 AND {_SHORT} >= 0.75)"
_REASON = f"""CASE WHEN t = '' THEN 'empty' WHEN t LIKE '<%' THEN 'startswith_lt' WHEN length(t) < 200 THEN 'too_short'
 WHEN length(t) > 50000 THEN 'too_long' WHEN {_RUNS} THEN 'placeholders'
 WHEN {_TAGS} > (CASE WHEN {_TAGGED} THEN 0.01 ELSE 0.02 END) THEN 'html_heavy'
 WHEN {_URLS} > 0.0025 THEN 'url_spam' WHEN {_MENU} THEN 'menu_spam' WHEN {_ASCII} < 0.75 THEN 'low_ascii' END"""


@query(
    f"""WITH r AS (SELECT row_id, lang, t, {_REASON} AS reason FROM {_DOCS}),
 f AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, sha1(t) ORDER BY row_id) > 1 THEN 'duplicate' ELSE coalesce(reason, 'kept') END AS verdict FROM r)
 SELECT lang, verdict, count(*) AS documents, sum(length(t)) AS chars FROM f GROUP BY ALL"""
)
def clean_reasons(spark, d):
    """The cleaning cascade with exact deduplication of what it keeps, counted by language."""
    t = docs(spark, d, F.lower(F.trim("lang")).alias("lang")).where("text IS NOT NULL").withColumn("t", clean())
    t = cut(t.select("row_id", "lang", F.length("t").alias("n"), F.sha1("t").alias("h"), T.reject_reason("t").alias("reason")))  # the cascade runs once
    kept = t.where("reason IS NULL").groupBy("h").agg(F.min("row_id").alias("first"))
    joined = spread_join(t, kept, "h", "left")
    verdict = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("first") != F.col("row_id"), "duplicate").otherwise("kept")
    return joined.groupBy("lang", verdict.alias("verdict")).agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))


@query(
    f"""SELECT row_id, round({_ASCII}, 9) AS ascii, round({_n('t', '[^\\p{L}\\p{N}\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]')} / greatest(length(t), 1)::DOUBLE, 9) AS symbols, round({_URLS}, 9) AS urls, round({_SHORT}, 9) AS short_lines,
 round({_TAGS}, 9) AS html, len({_LINES}) AS lines, {_n('t', '(?m)^\\s*\\d+[.)]\\s+')} AS numbered, {_n('t', '[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_]*')} AS runs FROM {_DOCS}"""
)
def text_metrics(spark, d):
    t = docs(spark, d).where("text IS NOT NULL").withColumn("t", clean())
    nine = lambda c: F.round(c, 9)
    return t.select(
        "row_id", nine(T.ascii_ratio("t")).alias("ascii"), nine(T.symbol_ratio("t")).alias("symbols"), nine(T.url_density("t")).alias("urls"), nine(T.short_line_ratio("t")).alias("short_lines"),
        nine(T.html_score("t")).alias("html"), T.line_count("t").cast("long").alias("lines"), T.numbered_count("t").cast("long").alias("numbered"), T.count_of("t", r"[\p{L}\p{M}\p{N}_]+").cast("long").alias("runs"),
    )


_FIRST = f"coalesce({_strip(f'{_LINES}[1]')}, '')"
_LABEL = f"""CASE WHEN h = '' THEN 'empty' WHEN h LIKE '```%' THEN 'fence' WHEN h LIKE '|%' THEN 'pipes_table' WHEN regexp_matches(h, '^#{{1,6}}\\s+\\S') THEN 'md_heading'
 WHEN regexp_matches(h, '^-\\s+\\S') THEN 'dash_list' WHEN regexp_matches(h, '^\\*\\s+\\S') THEN 'star_list' WHEN regexp_matches(h, '^>\\s+\\S') THEN 'blockquote'
 WHEN h LIKE '\\_%' ESCAPE '\\' THEN 'underscores' WHEN regexp_matches(h, '^\\p{{Nd}}') THEN 'digit' WHEN regexp_matches(h, '^\\p{{L}}') THEN 'alpha' ELSE 'other_symbol' END"""


@query(f"WITH x AS (SELECT row_id, source, {_FIRST} AS h FROM {_DOCS}) SELECT source, {_LABEL} AS label, count(*) AS n, min(row_id) AS first_seen FROM x GROUP BY ALL")
def head_label_stats(spark, d):
    t = docs(spark, d, "source").where("text IS NOT NULL").select("row_id", "source", T.head_label(clean()).alias("label"))
    return rows.counter(t, ["source", "label"])


_CODE = "(SELECT row_id, lower(regexp_extract(meta.path, '\\.([^./]+)$', 1)) AS ext, text AS t FROM code_files WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"


@query(
    f"""SELECT row_id, ext, CASE WHEN regexp_matches(t, '^\\s*#!/usr/bin/(env )?python') OR regexp_matches(t, '(?m)^\\s*def\\s+\\w+\\s*\\(|^\\s*class\\s+\\w+\\s*[:(]') OR contains(t, 'if __name__ == ''__main__'':') OR contains(t, 'if __name__ == "__main__":') THEN true
 WHEN {" OR ".join(f"contains(t, '{n}')" for n in T.NOT_PYTHON)} OR {_n('t', '[{}]')} > 8 OR {_n('t', ';')} > 12 OR len({_LINES}) = 0 THEN false
 WHEN len(list_filter(({_LINES})[1:200], lambda x: x LIKE '    %')) >= 6 AND len(list_filter(({_LINES})[1:200], lambda x: regexp_matches(x, ':\\s*$'))) >= 2 THEN true
 ELSE {_n('t', 'def |class |import |from |None|True|False')} >= 2 END AS python FROM {_CODE}"""
)
def python_guess(spark, d):
    """Whether a code file looks like Python, by text alone."""
    t = one_delivery(table(spark, d, "code_files")).where("text IS NOT NULL")
    return t.select("row_id", F.lower(F.regexp_extract("meta.path", r"\.([^./]+)$", 1)).alias("ext"), T.guess_python("text").alias("python"))


@query(
    f"""SELECT ext, count(*) AS files, sum(({" OR ".join(f"contains(t, '{n}')" for n in T.CODE_NEEDLES)} OR (contains(t, '{{') AND contains(t, '}}')) OR (contains(t, ';') AND contains(t, chr(10))) OR ({_n('t', '\\n')} >= 8 AND {_n('t', '[()]')} >= 6))::INT) AS code,
 sum((contains(t, '```') OR len(list_filter(string_split(t, chr(10))[1:60], lambda x: regexp_matches(x, '^\\s*#{{1,6}}\\s+\\S'))) >= 2 OR {_n("array_to_string(string_split(t, chr(10))[1:60], chr(10))", '\\|')} >= 24)::INT) AS markdown FROM {_CODE} GROUP BY ext"""
)
def code_signals(spark, d):
    t = one_delivery(table(spark, d, "code_files")).where("text IS NOT NULL").withColumn("ext", F.lower(F.regexp_extract("meta.path", r"\.([^./]+)$", 1)))
    return t.groupBy("ext").agg(F.count("*").alias("files"), F.sum(T.looks_like_code("text").cast("long")).alias("code"), F.sum(T.markdownish("text").cast("long")).alias("markdown"))


_META = "regexp_extract(t, '^((<[^>\\n]{1,64}>[^\\n]*(\\n|\\z)){1,8})', 1)"
_META_SQL = (
    "SELECT row_id, CASE WHEN META = '' THEN 0 ELSE len(regexp_extract_all(regexp_replace(META, '\\n$', ''), '\\n')) + 1 END AS stripped,"
    " sha1(regexp_replace(t, '^(<[^>\\n]{1,64}>[^\\n]*(\\n|\\z)){1,8}\\n*', '')) AS digest FROM "
).replace("META", _META) + _CODE


@query(_META_SQL)
def meta_strip(spark, d):
    t = one_delivery(table(spark, d, "code_files")).where("text IS NOT NULL")
    return t.select("row_id", T.meta_line_count("text").cast("long").alias("stripped"), T.sha1(T.strip_meta_lines("text")).alias("digest"))


@query(
    f"""WITH x AS (SELECT source, t, {_FIRST} AS h FROM {_DOCS}), y AS (SELECT source, t, {_LABEL} AS label FROM x)
 SELECT source, CASE WHEN label IN ('pipes_table', 'fence', 'underscores') THEN 'head_pattern' WHEN length(t) > 0 AND length(regexp_replace(left(t, 256), '[^\\x00-\\x7F]', '', 'g')) / length(left(t, 256))::DOUBLE < 0.92 THEN 'head_ascii'
 WHEN length(t) > 0 AND {_ASCII} < 0.92 THEN 'ascii' WHEN {_n('t', '[^\\p{L}\\p{N}\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]')} / greatest(length(t), 1)::DOUBLE > 0.3 THEN 'symbols'
 WHEN length(t) < 200 THEN 'too_short' WHEN length(t) > 20000 THEN 'too_long' ELSE 'kept' END AS verdict, count(*) AS n FROM y GROUP BY ALL"""
)
def generic_filter(spark, d):
    t = docs(spark, d, "source").where("text IS NOT NULL").select("source", F.coalesce(T.generic_reason(clean()), F.lit("kept")).alias("verdict"))
    return t.groupBy("source", "verdict").agg(F.count("*").alias("n"))


@query()
def wiki_filter(spark, d):
    """Verdicts of the encyclopedia cascade (tail cut, templates, paragraphs), by source."""
    t = docs(spark, d, "source").where("text IS NOT NULL").select("source", F.coalesce(T.wiki_reason(clean()), F.lit("kept")).alias("verdict"))
    return t.groupBy("source", "verdict").agg(F.count("*").alias("n"))


@query()
def code_filter(spark, d):
    """Verdicts of the code cascade, by extension."""
    t = one_delivery(table(spark, d, "code_files")).select(F.lower(F.regexp_extract("meta.path", r"\.([^./]+)$", 1)).alias("ext"), F.coalesce(T.code_reason(T.code_normal("text")), F.lit("kept")).alias("verdict"))
    return t.groupBy("ext", "verdict").agg(F.count("*").alias("n"))


@query(
    f"""SELECT source, count(*) AS documents, round(avg({_ASCII}), 9) AS ascii_mean, round(avg(contains(t, chr(10) || chr(10))::INT), 9) AS with_blank_line, round(avg(regexp_matches(t, '(?i)https?://\\S+|www\\.\\S+')::INT), 9) AS with_url,
 round(quantile_cont(length(t), 0.5), 6) AS chars_p50, round(quantile_cont(length(t), 0.95), 6) AS chars_p95, max(length(t)) AS chars_max FROM {_DOCS} GROUP BY source"""
)
def quality_report(spark, d):
    t = docs(spark, d, "source").where("text IS NOT NULL").withColumn("t", clean())
    flags = T.quality_flags("t")
    return t.groupBy("source").agg(
        F.count("*").alias("documents"), F.round(F.avg(T.ascii_ratio("t")), 9).alias("ascii_mean"), F.round(F.avg(flags["blank_line"].cast("int")), 9).alias("with_blank_line"), F.round(F.avg(flags["url"].cast("int")), 9).alias("with_url"),
        F.round(F.percentile(F.length("t"), F.lit(0.5)), 6).alias("chars_p50"), F.round(F.percentile(F.length("t"), F.lit(0.95)), 6).alias("chars_p95"), F.max(F.length("t")).cast("long").alias("chars_max"),
    )


@query(
    """WITH x AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL), q AS (SELECT unnest([0.0, 0.5, 0.9, 0.95, 0.99, 1.0])::DOUBLE AS q)
 SELECT q, v AS value FROM q JOIN x ON i = round_even((n - 1) * q, 0)"""
)
def length_quantiles(spark, d):
    return rows.nearest_rank(table(spark, d, "documents").select("n_chars"), "n_chars", [0.0, 0.5, 0.9, 0.95, 0.99, 1.0])


# -- deduplication ---------------------------------------------------------------------------------------
@query(f"SELECT row_id, source FROM {_DOCS} QUALIFY row_number() OVER (PARTITION BY sha1(t) ORDER BY row_id) = 1")
def exact_dedup_first(spark, d):
    t = docs(spark, d, "source").where("text IS NOT NULL").select("row_id", "source", T.sha1(clean()).alias("h"))
    return rows.first_of(t, [F.col("h")]).select("row_id", "source")


_HASHKEY = f"regexp_replace(lower({_strip('t')}), '{_WS}+', ' ', 'g')"


@query(f"SELECT row_id, nullif(first_value(row_id) OVER (PARTITION BY sha1({_HASHKEY}) ORDER BY row_id), row_id) AS duplicate_of FROM {_DOCS}")
def dedup_audit(spark, d):
    t = docs(spark, d).where("text IS NOT NULL").select("row_id", T.sha1(T.hash_key(clean())).alias("h"))
    return rows.audit(t, F.col("h")).select("row_id", "duplicate_of")


@query(f"SELECT row_id FROM {_ANS} QUALIFY row_number() OVER (PARTITION BY coalesce(lower(prompt), chr(1)), lower(a) ORDER BY row_id) = 1")
def composite_dedup(spark, d):
    return rows.first_of(answers(spark, d), [F.coalesce(F.lower("prompt"), F.lit("\x01")), F.lower("a")]).select("row_id")


@query(f"SELECT x.row_id FROM {_DOCS} x WHERE sha1(x.t) NOT IN (SELECT sha1(t) FROM {_DOCS} WHERE source = 'webedu_mix')")
def anti_join_seen(spark, d):
    t = docs(spark, d, "source").where("text IS NOT NULL").select("row_id", "source", T.sha1(clean()).alias("h"))
    return rows.not_seen(t, t.where("source = 'webedu_mix'"), "h").select("row_id")


@query(f"WITH x AS (SELECT row_id, meta.split AS split, coalesce(array_to_string(list_transform(m, lambda y: y.role || ': ' || y.content), chr(10) || chr(10)), '') AS k FROM {_MIX}) SELECT row_id, split FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY (CASE split WHEN 'val' THEN 0 WHEN 'test' THEN 1 ELSE 2 END), row_id) = 1")
def cross_split_dedup(spark, d):
    t = mix_turns(spark, d).select("row_id", F.col("meta.split").alias("split"), F.md5(chat.render(F.col("m"))).alias("k"))
    rank = F.when(F.col("split") == "val", 0).when(F.col("split") == "test", 1).otherwise(2)
    return rows.across_splits(t, F.col("k"), rank).select("row_id", "split")


@query()
def near_dup_pairs(spark, d):
    """Document pairs whose sets of five-word shingles agree in 0.8 or more; copies pair with their first."""
    t = docs(spark, d).where("text IS NOT NULL").select("row_id", T.shingles("text", 5).alias("s"))
    return rows.similar_pairs(t, "s", 0.8)


@query()
def greedy_near_dedup(spark, d):
    """Documents kept when each is dropped that is near-same to a kept earlier one."""
    t = docs(spark, d).where("text IS NOT NULL").select("row_id", T.shingles("text", 5).alias("s"))
    return rows.greedy_keep(rows.similar_pairs(t, "s", 0.8), t.select("row_id"))


@query(
    """WITH e AS (SELECT doc_id, chunk FROM (SELECT doc_id, unnest(list_transform(range(0, (length(text) - 256)::BIGINT + 1, 64), lambda i: md5(substr(text, i::INT + 1, 256)))) AS chunk FROM documents WHERE length(text) >= 256))
 , g AS (SELECT chunk, count(*) AS c FROM e GROUP BY chunk) SELECT sum(c) AS blocks, count(*) AS different, round(sum(c - 1) / sum(c)::DOUBLE, 9) AS duplicate_rate FROM g"""
)
def window_dup_rate(spark, d):
    """Sliding windows of 256 characters at steps of 64."""
    t = docs(spark, d).where(F.length("text") >= 256)
    return rows.duplicate_rate(t.select(F.explode(rows.windows_of(F.col("text"), 256, 64)).alias("h")))


@query(
    """WITH e AS (SELECT unnest(list_transform(range(0, (length(text) - 128)::BIGINT + 1, 128), lambda i: md5(substr(text, i::INT + 1, 128)))) AS chunk FROM documents WHERE length(text) >= 128)
 , g AS (SELECT chunk, count(*) AS c FROM e GROUP BY chunk) SELECT sum(c) AS blocks, count(*) AS different, round(sum(c - 1) / sum(c)::DOUBLE, 9) AS duplicate_rate FROM g"""
)
def block_dup_rate(spark, d):
    """Blocks of 128 characters."""
    t = docs(spark, d).where(F.length("text") >= 128)
    return rows.duplicate_rate(t.select(F.explode(rows.windows_of(F.col("text"), 128, 128)).alias("h")))


# -- chat ------------------------------------------------------------------------------------------------
@query(f"SELECT row_id, len(m) AS turns, coalesce(sum_len, 0) AS chars FROM (SELECT row_id, m, list_sum(list_transform(m, lambda x: length(x.content))) AS sum_len FROM {_MIX}) WHERE m IS NOT NULL")
def chat_messages(spark, d):
    t = mix_turns(spark, d).join(table(spark, d, "sft_mix").where("messages IS NOT NULL").select("row_id").distinct(), "row_id", "left_semi")
    return t.select("row_id", F.size("m").cast("long").alias("turns"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"))


@query(f"SELECT row_id, list_filter(m, lambda x: x.role = 'user')[-1].content AS last_user, list_filter(m, lambda x: x.role = 'assistant')[-1].content AS last_assistant FROM {_MIX}")
def chat_last_turns(spark, d):
    t = mix_turns(spark, d)
    return t.select("row_id", chat.last_content(F.col("m"), "user").alias("last_user"), chat.last_content(F.col("m"), "assistant").alias("last_assistant"))


@query()
def chat_rounds(spark, d):
    """One round of each exchange with a default system turn, rendered."""
    t = mix_turns(spark, d).where(F.size("m") > 0)
    cut = chat.with_system(chat.first_rounds(chat.without_trailing_user(F.col("m")), 1), "You are a helpful assistant.")
    return t.select("row_id", F.size(cut).alias("turns"), T.sha1(chat.render(cut)).alias("digest"))


@query()
def chat_tail_dedup(spark, d):
    return rows.first_of(mix_turns(spark, d).where(F.size("m") > 0), [chat.tail_key(F.col("m"))]).select("row_id")


@query()
def rl_prompts(spark, d):
    """Prompts up to the last user turn, one for each text, with the answer that follows."""
    t = mix_turns(spark, d).where(chat.has_role(F.col("m"), "user"))
    t = t.select("row_id", F.to_json(chat.prompt_turns(F.col("m"))).alias("prompt"), chat.answer_after_last_user(F.col("m")).alias("reference"))
    return rows.first_of(t, [F.col("prompt")])


@query(f"WITH x AS (SELECT row_id, meta.dataset AS dataset, lower(array_to_string(list_transform(list_filter(m, lambda y: y.role = 'user'), lambda y: y.content), chr(10))) AS u FROM {_MIX}) SELECT dataset, count(*) AS kept FROM x WHERE (contains(u, 'python') OR contains(u, 'function') OR contains(u, 'note')) AND NOT (contains(u, 'fix') OR contains(u, 'regex')) GROUP BY dataset")
def prompt_filters(spark, d):
    u = chat.user_text(F.col("m"))
    t = mix_turns(spark, d).where(T.any_of(u, ["python", "function", "note"]) & ~T.any_of(u, ["fix", "regex"]))
    return t.groupBy(F.col("meta.dataset").alias("dataset")).agg(F.count("*").alias("kept"))


# -- quotas, order, splits -------------------------------------------------------------------------------
@query(
    """WITH s AS (SELECT source, count(*) AS weight FROM documents GROUP BY source), r AS (SELECT *, round(weight / sum(weight) OVER () * 1000, 9) AS raw FROM s), f AS (SELECT *, floor(raw) AS fl FROM r),
 k AS (SELECT *, row_number() OVER (ORDER BY round(raw - fl, 9) DESC, source DESC) AS rk, 1000 - sum(fl) OVER () AS lft FROM f) SELECT source, weight, (fl + (rk <= lft)::INT)::BIGINT AS quota FROM k"""
)
def quota_largest_remainder(spark, d):
    return rows.largest_remainder(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("weight")), 1000).select("source", "weight", F.col("quota").cast("long").alias("quota"))


_BEFORE = "coalesce(sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(f"WITH x AS (SELECT doc_id AS row_id, source, coalesce(n_chars, 0) AS n, {_BEFORE} AS b FROM documents) SELECT source, count(*) AS kept, sum(n) AS chars FROM x WHERE b < 20000 GROUP BY source")
def budget_fill(spark, d):
    """Documents of each source until 20,000 characters are reached."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return rows.fill_budget(t, ["source"], F.col("n"), F.lit(20_000)).groupBy("source").agg(F.count("*").alias("kept"), F.sum("n").alias("chars"))


@query(f"SELECT doc_id AS row_id, CASE WHEN {_BEFORE} < 5000 THEN 'val' ELSE 'train' END AS split FROM documents")
def val_first_routing(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return rows.route_val_first(t, ["source"], F.col("n"), F.lit(5000)).select("row_id", "split")


@query(
    """WITH x AS (SELECT doc_id AS row_id, coalesce(n_chars, 0) AS n, coalesce(sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
 SELECT row_id, (b // 100000)::BIGINT AS first_shard, ((b + greatest(n - 1, 0)) // 100000)::BIGINT AS last_shard FROM x"""
)
def shard_assignment(spark, d):
    """Shards of 100,000 characters over all documents in order."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    return rows.shards(t, [], F.col("n"), 100_000).select("row_id", F.col("first_shard").cast("long").alias("first_shard"), F.col("last_shard").cast("long").alias("last_shard"))


@query()
def split_ratio_exact(spark, d):
    """A tenth of the documents of each source to val, by seeded hash."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.split_exact(t, 0.1, 11, ["source"]).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS row_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 200")
def sample_seeded(spark, d):
    """A seeded sample of 200 documents (a sampling operator)."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"))
    return rows.sample_exact(t, 200, 7)


@query(f"SELECT row_id, subfamily FROM {_ANS} WHERE length(a) > 0 QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY length(a), row_id) = 1")
def shortest_per_prompt(spark, d):
    t = answers(spark, d).where(F.length("a") > 0)
    return rows.best_of(t, ["prompt"], [F.length("a")]).select("row_id", "subfamily")


@query(f"SELECT row_id, family, row_number() OVER (PARTITION BY family ORDER BY len(regexp_extract_all(a, '\\.')) DESC, length(a), row_id) AS rank FROM {_ANS} QUALIFY rank <= 25")
def cap_per_family(spark, d):
    """The best 25 answers of each family (a top-k report)."""
    t = answers(spark, d)
    return rows.ranked_within(t, ["family"], [F.desc(T.count_of("a", "\\.")), F.length("a"), F.col("row_id")]).where("rank <= 25").select("row_id", "family", F.col("rank").cast("long").alias("rank"))


@query("SELECT c.row_id, s.target_weight IS NOT NULL AS known, coalesce(s.max_repeats, 0) AS repeats FROM (SELECT doc_id AS row_id, source FROM documents) c LEFT JOIN mix_targets s USING (source)")
def lookup_join(spark, d):
    """Settings joined by key; the settings table never grows."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source")
    return t.join(F.broadcast(table(spark, d, "mix_targets")), "source", "left").select("row_id", F.col("target_weight").isNotNull().alias("known"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))


# -- answers and rewards ---------------------------------------------------------------------------------
@query()
def verify_answers(spark, d):
    """General and family reasons, scores and whether a failed answer can be repaired."""
    t = one_delivery(table(spark, d, "teacher_answers")).withColumn("a", F.coalesce(T.drop_reasoning("answer_raw"), F.lit("")))
    fam = F.coalesce("family", F.lit(""))
    why = F.concat(T.hard_reasons("a", F.coalesce("prompt", F.lit(""))), T.family_reasons("a", fam, F.col("constraints")))
    t = cut(t.select("row_id", fam.alias("family"), "a", why.alias("why")))  # the reasons are worked out once
    return t.select(
        "row_id", F.array_join("why", ",").alias("reasons"), T.instruction_score(F.col("why")).alias("instruction"), T.cleanliness_score(F.col("why")).alias("cleanliness"), T.brevity_score("a", F.col("family")).alias("brevity"),
        T.naturalness_score("a").alias("naturalness"), ((F.size("why") > 0) & T.repairable(F.col("why"))).alias("repairable"),
    )


@query()
def reject_counts(spark, d):
    why = T.hard_reasons("a", F.coalesce("prompt", F.lit("")))
    return answers(spark, d).select("row_id", "family", F.explode(why).alias("reason")).groupBy("family", "reason").agg(F.count("*").alias("n"))


_W = "list_filter(regexp_split_to_array(a, '[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+'), lambda w: w <> '')"


@query(
    f"""WITH x AS (SELECT row_id, {_W} AS w FROM {_ANS}), y AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM x)
 SELECT row_id, (len(w) > 0)::INT AS nonempty, round(CASE WHEN len(w) = 0 THEN 0 ELSE exp(-pow((len(w) - 40) / 40.0, 2)) END, 9) AS length_score,
 round(CASE WHEN len(w) < 4 THEN 1 ELSE len(list_distinct(g)) / (len(w) - 2)::DOUBLE END, 9) AS no_repeat FROM y"""
)
def reward_rules(spark, d):
    t = answers(spark, d)
    return t.select("row_id", (F.size(T.space_words("a")) > 0).cast("int").alias("nonempty"), F.round(T.length_score("a"), 9).alias("length_score"), F.round(T.distinct_trigrams("a"), 9).alias("no_repeat"))


@query(f"WITH x AS (SELECT row_id, coalesce(family, '') AS family, length(a)::DOUBLE AS r FROM {_ANS}) SELECT row_id, round((r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-4), 4) AS advantage FROM x WINDOW w AS (PARTITION BY family)")
def group_advantage(spark, d):
    t = answers(spark, d).select("row_id", F.coalesce("family", F.lit("")).alias("family"), F.length("a").cast("double").alias("r"))
    return rows.advantage(t, "family", "r").select("row_id", F.round("advantage", 4).alias("advantage"))


_FAMILY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(p, '{n}')" for n in ns) + f" THEN '{k}'" for k, ns in T.FAMILIES.items()) + " END"


@query(f"WITH x AS (SELECT lower(prompt) AS p, family FROM {_ANS}) SELECT family, {_FAMILY_SQL} AS guessed, count(*) AS n FROM x GROUP BY ALL")
def family_classify(spark, d):
    return answers(spark, d).groupBy("family", T.family_of("prompt").alias("guessed")).agg(F.count("*").alias("n"))


@query()
def prompt_overlap(spark, d):
    """Overlap of prompts and answers: words of the answer in the prompt, shingle similarity, echo."""
    t = answers(spark, d)
    return t.select("row_id", F.round(T.token_overlap("a", F.coalesce("prompt", F.lit(""))), 6).alias("overlap"), F.round(T.jaccard(T.shingles("a"), T.shingles(F.coalesce("prompt", F.lit("")))), 6).alias("jaccard"), T.prompt_echo("prompt", "a").alias("echo"))


# -- vectors, metrics, events ----------------------------------------------------------------------------
@query(
    """WITH u AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
 p AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u), s AS (SELECT label, list(x ORDER BY i) AS sv FROM (SELECT label, i, sum(x) AS x FROM p GROUP BY ALL) GROUP BY label), n AS (SELECT label, count(*) AS c FROM u GROUP BY label)
 SELECT label, count(*) AS vectors, round(avg(1 - (list_dot_product(v, sv) - list_dot_product(v, v)) / (c - 1)), 6) AS diversity FROM u JOIN s USING (label) JOIN n USING (label) WHERE c > 1 GROUP BY label"""
)
def semantic_diversity(spark, d):
    e = table(spark, d, "embeddings")
    key = "vec_id" if "vec_id" in e.columns else e.columns[0]
    scored = rows.diversity(e, "label", "embedding", key)
    return scored.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg("diversity"), 6).alias("diversity"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling hours over the events (the same plan runs on a stream)."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query()
def metric_ema(spark, d):
    """Daily means of every event type and their exponential moving average."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    series = e.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s"))  # one entry a day
    both = series.select("event_type", F.explode(F.arrays_zip(F.transform("s", lambda x: x["day"]).alias("day"), F.transform("s", lambda x: x["v"]).alias("v"), rows.ema(F.transform("s", lambda x: x["v"])).alias("ema"))).alias("z"))
    return both.select("event_type", "z.day", F.round("z.v", 6).alias("v"), F.round("z.ema", 6).alias("ema"))


@query()
def code_structure(spark, d):
    """Reasons against the reference solutions by the parser, with counts."""
    t = one_delivery(table(spark, d, "code_prompts"))
    got = verify.check_structure(t, "reference_code", "entry_point")
    return got.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def chars_per_token(spark, d):
    """Characters a token, per source and over all (source null)."""
    t = with_token_count(table(spark, d, "documents").select("source", "n_chars", "text"))
    return t.rollup("source").agg(F.sum("n_chars").alias("chars"), F.sum("n_tokens").alias("tokens"), F.round(F.sum("n_chars") / F.sum("n_tokens"), 6).alias("ratio"))


@query()
def token_blocks(spark, d):
    """Documents end to end in blocks of 1,025 ids: blocks and supervised labels by source."""
    t = tokens.with_ids(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", "text"))
    t = cut(t.where(F.size("ids") > 0).withColumn("ids", tokens.with_ends(F.col("ids"), None, 50256)))  # encoded once
    b = tokens.blocks(t, "ids", 1025, ["source"])
    live = F.aggregate(tokens.loss_mask(F.col("ids"), -1, 50256), F.lit(0), lambda a, x: a + x)
    return b.groupBy("source").agg(F.count("*").alias("blocks"), F.sum(live).alias("labels"), F.min(tokens.in_range(F.col("ids"), 50257).cast("int")).alias("all_in_range"))


@query()
def first_token_top(spark, d):
    """The ten most frequent first tokens, per source and over all (a top-k report)."""
    t = tokens.with_ids(table(spark, d, "documents").select("source", "text"))
    return tokens.first_tokens(t, "ids", "source", 10)


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
