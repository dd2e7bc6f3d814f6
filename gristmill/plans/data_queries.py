"""Queries over targets, quotas, acceptance, prompts, layouts and files, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, one_delivery, shared_folder, table
from ..functions import text as T
from ..functions.tokens import with_token_count
from ..operators import chat, quotas, rows, tokens
from ..sources import jsonl
from ..streaming import clean as streams
from .reference_queries import _ANS, _CODE, _MIX, _WS, _strip, answers, docs, mix_turns

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(table(spark, d, "general_prompts"))


_GEN = "(SELECT * FROM general_prompts QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"
_CP = "(SELECT * FROM code_prompts QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"


# -- targets and quotas ----------------------------------------------------------------------------------
@query(
    """WITH c AS (SELECT source AS name, target_weight AS weight, CASE WHEN max_repeats >= 3 THEN 'small' ELSE 'large' END AS bucket, CASE WHEN max_repeats >= 3 THEN 0.25 ELSE 0.75 END AS bucket_share, CASE WHEN max_repeats >= 4 THEN 1.5 ELSE 1.0 END AS upsample, sum(target_weight) OVER () AS w FROM mix_targets),
 t AS (SELECT bucket, name, floor(floor(1000000 * bucket_share) * (weight / w) * upsample)::BIGINT AS train_target FROM c WHERE weight > 0)
 SELECT bucket, name, train_target, greatest(floor(20000 * (train_target / sum(train_target) OVER ()::DOUBLE))::BIGINT, 300) AS val_target FROM t"""
)
def bucket_token_targets(spark, d):
    """Targets of every source from bucket shares, weights and upsampling; validation has a least target."""
    m = table(spark, d, "mix_targets")
    total = m.agg(F.sum("target_weight")).first()[0]
    many = F.col("max_repeats") >= 3
    config = m.select(F.col("source").alias("name"), (F.col("target_weight") / F.lit(total)).alias("weight"), F.when(many, "small").otherwise("large").alias("bucket"), F.when(many, 0.25).otherwise(0.75).alias("bucket_share"), F.when(F.col("max_repeats") >= 4, 1.5).otherwise(1.0).alias("upsample"))
    return quotas.bucket_targets(config, 1_000_000, 0.02, 300).select("bucket", "name", "train_target", "val_target")


@query(
    """WITH s AS (SELECT doc_id, source, coalesce(n_chars, 0) AS n FROM documents WHERE source IS NOT NULL), q AS (SELECT source, floor(2000000 * target_weight / (SELECT sum(target_weight) FROM mix_targets))::BIGINT AS quota FROM mix_targets),
 v AS (SELECT source, sum(n)::BIGINT AS supply FROM s GROUP BY source), p AS (SELECT source, quota, (quota // supply)::BIGINT AS whole, quota - (quota // supply) * supply AS rest FROM q JOIN v USING (source) WHERE supply > 0),
 r AS (SELECT s.*, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s), t AS (SELECT source, n, whole + (b < rest)::INT AS times FROM r JOIN p USING (source))
 SELECT source, count(*) AS documents, max(times)::BIGINT AS epochs, sum(n * times)::BIGINT AS chars FROM t WHERE times > 0 GROUP BY source"""
)
def epoch_mix(spark, d):
    """A mixture of two million characters by weight; sources that are too small start over."""
    m = table(spark, d, "mix_targets")
    total = m.agg(F.sum("target_weight")).first()[0]
    quota = m.select("source", F.floor(F.lit(2_000_000) * F.col("target_weight") / F.lit(total)).cast("long").alias("quota"))
    t = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("row_id"), "source", F.coalesce("n_chars", F.lit(0)).alias("n"))
    used = quotas.epochs(t, "source", "n", quota)
    return used.groupBy("source").agg(F.count("*").alias("documents"), F.max("times").alias("epochs"), F.sum(F.col("n") * F.col("times")).alias("chars"))


@query(f"WITH x AS (SELECT meta.dataset AS dataset, count(*) AS n FROM {_MIX} GROUP BY ALL) SELECT dataset, n, least(greatest(20, floor(n * 0.05)), n // 5 + 1)::BIGINT AS n_val FROM x")
def val_size_rule(spark, d):
    return quotas.val_sizes(mix_turns(spark, d).select(F.col("meta.dataset").alias("dataset")), "dataset", 0.05, 20)


@query(
    f"""WITH q AS (SELECT * FROM (VALUES ('mbpp_like', 60), ('core_families', 40)) v(name, quota)), r AS (SELECT row_id, source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY row_id) AS rk FROM {_CP}),
 f AS (SELECT row_id, source, rk <= coalesce(quota, 0) AS first_choice FROM r LEFT JOIN q ON coalesce(source, '') = name), p AS (SELECT *, row_number() OVER (PARTITION BY first_choice ORDER BY row_id) AS place, sum(first_choice::INT) OVER () AS nf FROM f)
 SELECT row_id, source, first_choice FROM p WHERE place <= CASE WHEN first_choice THEN 150 ELSE greatest(0, 150 - nf) END"""
)
def source_quota_topup(spark, d):
    """Quotas of named sources, topped up to 150 prompts from the others (a quota operator)."""
    t = one_delivery(table(spark, d, "code_prompts")).select("row_id", "source")
    return quotas.quotas_with_topup(t, "source", {"mbpp_like": 60, "core_families": 40}, 150).select("row_id", "source", "first_choice")


@query(
    f"""WITH n AS (SELECT coalesce(family, '') AS family, count(*) AS n FROM {_GEN} GROUP BY ALL), a AS (SELECT *, sum(n) OVER () AS available, row_number() OVER (ORDER BY family) AS i, count(*) OVER () AS k FROM n),
 q AS (SELECT family, n, i, k, least(round_even(200 * n / available::DOUBLE, 0), n) AS q0 FROM a), l AS (SELECT family, n, CASE WHEN i < k THEN q0 ELSE greatest(0, least(200 - coalesce(sum(q0) FILTER (WHERE i < k) OVER (), 0), n)) END AS quota FROM q),
 u AS (SELECT *, 200 - sum(quota) OVER () AS open, row_number() OVER (PARTITION BY quota < n ORDER BY family) AS turn FROM l) SELECT family, n AS available, (quota + (quota < n AND turn <= open)::INT)::BIGINT AS quota FROM u"""
)
def family_quota_topup(spark, d):
    """Proportional quotas of the families for 200 prompts, topped up in turn."""
    n = {r[0]: r[1] for r in _prompts(spark, d).groupBy(F.coalesce("family", F.lit("")).alias("f")).agg(F.count("*")).collect()}  # one row a family
    got = quotas.family_quotas(n, 200)
    return spark.createDataFrame([(f, n[f], got[f]) for f in sorted(n)], "family string, available long, quota long")


_GROUP = f"(SELECT row_id, coalesce(nullif(trim(meta.parent_seed_id), ''), nullif(trim(source_key), ''), 'hash_' || sha1(coalesce(canonical_prompt, ''))) AS gid FROM {_GEN})"


@query(
    f"""WITH g AS (SELECT gid, count(*) AS n FROM {_GROUP} GROUP BY gid), o AS (SELECT *, ('0x' || left(md5('5:' || gid), 15))::BIGINT AS h FROM g), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS total FROM o),
 t AS (SELECT *, least(greatest(1, round_even(total * 0.1, 0)), greatest(1, total - 1)) AS target FROM r), s AS (SELECT min(b) AS stop FROM t WHERE (b > 0 AND b + n > target) OR b >= target)
 SELECT CASE WHEN stop IS NULL OR b < stop THEN 'val' ELSE 'train' END AS split, count(*) AS groups, sum(n)::BIGINT AS rows FROM t, s GROUP BY ALL"""
)
def group_val_split(spark, d):
    """Whole groups go to val up to a tenth of the rows; groups by the first key that a row has."""
    t = _prompts(spark, d).select("row_id", chat.group_id([F.col("meta.parent_seed_id"), F.col("source_key")], F.coalesce("canonical_prompt", F.lit(""))).alias("gid"))
    return quotas.groups_to_val(t, "gid", 0.1, 5).groupBy("split").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


@query(f"SELECT coalesce(family, '') AS family, row_id, row_number() OVER (PARTITION BY coalesce(family, '') ORDER BY length(a), row_id) AS rank FROM {_ANS} QUALIFY rank <= 40")
def shortest_of_family(spark, d):
    """The 40 shortest answers of each family (a top-k report), without sorting a family in one task."""
    t = answers(spark, d).select("row_id", F.coalesce("family", F.lit("")).alias("family"), F.length("a").alias("n"))
    return quotas.top_of_groups(t, ["family"], [F.col("n")], 40).select("family", "row_id", F.col("rank").cast("long").alias("rank"))


# -- reports ---------------------------------------------------------------------------------------------
@query(
    """WITH u AS (SELECT source, sum(coalesce(n_chars, 0))::BIGINT AS chars FROM documents GROUP BY source) SELECT m.source, round(target_weight / sum(target_weight) OVER (), 9) AS weight, coalesce(chars, 0)::BIGINT AS chars,
 round(coalesce(chars, 0) / sum(coalesce(chars, 0)) OVER ()::DOUBLE, 9) AS share, round(coalesce(chars, 0) / sum(coalesce(chars, 0)) OVER ()::DOUBLE - target_weight / sum(target_weight) OVER (), 9) AS error FROM mix_targets m LEFT JOIN u USING (source)"""
)
def share_report(spark, d):
    """Actual shares of the configured sources beside their weights."""
    used = table(spark, d, "documents").groupBy("source").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))
    return rows.share_report(used, table(spark, d, "mix_targets"), "source", "chars", "target_weight")


@query(
    f"""WITH x AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, text IS NOT NULL AND length(text) >= 200 AS kept FROM documents), r AS (SELECT *, coalesce(sum(CASE WHEN kept THEN n ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
 SELECT source, count(*) AS seen, sum(kept::INT)::BIGINT AS kept, sum((kept AND b < 5000)::INT)::BIGINT AS val, sum((kept AND b >= 5000)::INT)::BIGINT AS train, sum((NOT kept)::INT)::BIGINT AS dropped FROM r GROUP BY source"""
)
def source_counters(spark, d):
    """Documents seen, kept, routed and dropped of each source."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", F.coalesce("n_chars", F.lit(0)).alias("n"), (F.coalesce(F.length("text"), F.lit(0)) >= 200).alias("kept"))
    run = rows.running_total(t, ["source"], F.when(F.col("kept"), F.col("n")).otherwise(0), "b")
    one = lambda c: F.sum(c.cast("long"))
    return run.groupBy("source").agg(F.count("*").alias("seen"), one(F.col("kept")).alias("kept"), one(F.col("kept") & (F.col("b") < 5000)).alias("val"), one(F.col("kept") & (F.col("b") >= 5000)).alias("train"), one(~F.col("kept")).alias("dropped"))


_NUMS = "list_transform(regexp_extract_all(prompt, '\\d+'), lambda x: x::BIGINT)"


@query(
    f"""WITH x AS (SELECT family, {_NUMS} AS p, regexp_extract_all(a, '-?\\d+(?:\\.\\d+)?') AS g FROM {_ANS} WHERE contains(lower(prompt), 'how many') AND len({_NUMS}) = 2)
 SELECT family, count(*) AS items, sum(coalesce(len(g) > 0 AND trunc(g[-1]::DOUBLE) = p[1] - p[2], false)::INT)::BIGINT AS correct, round(sum(coalesce(len(g) > 0 AND trunc(g[-1]::DOUBLE) = p[1] - p[2], false)::INT) / greatest(count(*), 1)::DOUBLE, 6) AS accuracy FROM x GROUP BY family"""
)
def arithmetic_accuracy(spark, d):
    """Share of right answers to subtractions in words: the last number, cut to a whole one."""
    nums = F.transform(F.regexp_extract_all("prompt", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    t = answers(spark, d).where(F.lower("prompt").contains("how many")).withColumn("p", nums).where(F.size("p") == 2)
    ok = F.coalesce(T.last_number("a").cast("long") == F.col("p")[0] - F.col("p")[1], F.lit(False)).cast("long")
    return t.groupBy("family").agg(F.count("*").alias("items"), F.sum(ok).alias("correct"), F.round(F.sum(ok) / F.greatest(F.count("*"), F.lit(1)), 6).alias("accuracy"))


_AKEY = f"replace(lower({_strip('a')}), ' ', '')"


@query(
    f"""WITH x AS (SELECT row_id, prompt, {_AKEY} AS k, regexp_extract_all(a, '\\d+(?:\\.\\d+)?') AS nums, min(row_id) OVER (PARTITION BY prompt) AS first FROM {_ANS} WHERE prompt IS NOT NULL), b AS (SELECT prompt, k AS bk, nums AS bn FROM x WHERE row_id = first)
 SELECT x.row_id, CASE WHEN k = bk THEN 'text' WHEN len(nums) > 0 AND nums = bn THEN 'numbers' ELSE 'no' END AS matched FROM x JOIN b USING (prompt)"""
)
def answer_key_match(spark, d):
    """Answers against the first answer to their prompt: the same text, or else the same numbers in order."""
    t = answers(spark, d).where("prompt IS NOT NULL").select("row_id", F.md5("prompt").alias("p"), T.answer_key("a").alias("k"), F.regexp_extract_all("a", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)).alias("nums"))
    return rows.key_match(cut(t), "p", "k", "nums")


# -- chat, preferences, prompts --------------------------------------------------------------------------
_ROUNDS = "list_filter(list_transform(range(1, len(m) + 1), lambda i: {'i': i, 'r': m[i].role, 'c': m[i].content}), lambda x: x.r <> 'system' OR x.i > 1)[1:4]"


@query(
    f"""WITH x AS (SELECT row_id, meta.dataset AS dataset, m, {_ROUNDS} AS t FROM {_MIX} WHERE len(m) > 0), y AS (SELECT row_id, dataset, m, CASE WHEN len(t) > 0 AND t[-1].r = 'user' THEN t[1:len(t) - 1] ELSE t END AS t FROM x)
 SELECT dataset, CASE WHEN len(list_filter(m, lambda z: z.role = 'assistant' AND contains(z.content, 'config.toml'))) > 0 THEN 'banned' WHEN len(list_filter(m, lambda z: z.role = 'assistant' AND length({_strip('z.content')}) < 16)) > 0 THEN 'short_answer'
 WHEN len(list_filter(t, lambda z: z.r = 'user')) = 0 THEN 'no_user' WHEN len(list_filter(t, lambda z: z.r = 'assistant')) = 0 THEN 'no_assistant' ELSE 'kept' END AS verdict, count(*) AS n FROM y GROUP BY ALL"""
)
def chat_acceptance(spark, d):
    """Why exchanges are not taken: banned parts, short answers, roles that are missing after two rounds."""
    t = mix_turns(spark, d).where(F.size("m") > 0)
    return t.groupBy(F.col("meta.dataset").alias("dataset"), chat.acceptance(F.col("m"), ["config.toml"], 16, 2).alias("verdict")).agg(F.count("*").alias("n"))


@query()
def chat_encoding(spark, d):
    """Exchanges as token ids with labels on the assistant's turns: ids, supervised ids, exchanges above 1,024 ids."""
    t = mix_turns(spark, d).where(F.size("m") > 0).select("row_id", F.col("meta.dataset").alias("dataset"), chat.with_system(F.col("m"), "You are a helpful assistant.").alias("m"))
    e = tokens.encode_chat(t, "m", tokens.ChatIds(50257, 50258, 50259, 50260, 50256))
    live = F.size(F.filter("labels", lambda x: x >= 0))
    return e.groupBy("dataset").agg(F.count("*").alias("exchanges"), F.sum(F.size("ids")).alias("ids"), F.sum(live).alias("supervised"), F.sum((F.size("ids") > 1024).cast("long")).alias("too_long"))


@query(
    f"""WITH x AS (SELECT prompt, {_strip('a')} AS a, row_id FROM {_ANS} WHERE prompt IS NOT NULL), p AS (SELECT prompt, arg_max(a, (length(a), -row_id)) AS chosen, arg_min(a, (length(a), row_id)) AS rejected, count(*) AS n FROM x GROUP BY prompt)
 SELECT CASE WHEN n < 2 THEN 'single' WHEN chosen = '' OR rejected = '' THEN 'empty' WHEN chosen = rejected THEN 'same' WHEN length(rejected) < 8 THEN 'short' WHEN length(prompt) > 600 THEN 'long_prompt' ELSE 'kept' END AS verdict, count(*) AS pairs FROM p GROUP BY ALL"""
)
def preference_acceptance(spark, d):
    """Longest and shortest answer to a prompt as a pair, and why pairs are not taken."""
    t = answers(spark, d).where("prompt IS NOT NULL").select("row_id", "prompt", T.strip("a").alias("a"))
    long, short = F.struct(F.length("a"), -F.col("row_id")), F.struct(F.length("a"), F.col("row_id"))
    p = t.groupBy("prompt").agg(F.max_by("a", long).alias("chosen"), F.min_by("a", short).alias("rejected"), F.count("*").alias("n"))
    return p.groupBy(F.when(F.col("n") < 2, "single").otherwise(chat.pair_verdict(F.col("prompt"), F.col("chosen"), F.col("rejected"), 8, 600)).alias("verdict")).agg(F.count("*").alias("pairs"))


_BANNED = ["python", "javascript", "sql", "regex"]


@query(
    f"""WITH x AS (SELECT row_id, family, {_strip("regexp_replace(raw_prompt, '(?i)^\\s*(user|instruction):\\s*', '')")} AS p, coalesce(nullif(trim(meta.parent_seed_id), ''), nullif(trim(source_key), ''), 'hash_' || sha1(coalesce(canonical_prompt, ''))) AS gid FROM {_GEN}),
 w AS (SELECT *, list_filter(regexp_split_to_array(p, '{_WS}+'), lambda v: v <> '') AS w FROM x) SELECT row_id, gid AS group_id, CASE WHEN p IS NULL OR p = '' THEN 'empty' WHEN {' OR '.join(f"contains(lower(p), '{b}')" for b in _BANNED)} THEN 'banned_keyword' WHEN len(w) < 6 THEN 'too_short' WHEN len(w) > 80 THEN 'too_long' WHEN family IS NULL THEN 'no_family' ELSE 'kept' END AS verdict FROM w"""
)
def canonical_prompts(spark, d):
    """Open prompts: why one is not taken, and the group that it belongs to."""
    t = _prompts(spark, d).withColumn("p", T.drop_prefix("raw_prompt"))
    gid = chat.group_id([F.col("meta.parent_seed_id"), F.col("source_key")], F.coalesce("canonical_prompt", F.lit("")))
    why = F.coalesce(F.when(F.coalesce("p", F.lit("")) == "", "empty"), T.open_prompt_reason("p", _BANNED), F.when(F.col("family").isNull(), "no_family"), F.lit("kept"))
    return t.select("row_id", gid.alias("group_id"), why.alias("verdict"))


@query(
    f"""WITH x AS (SELECT row_id, prompt, list_filter(list_transform(regexp_extract_all(prompt, '["“]([^"“”]+)["”]', 1), lambda q: {_strip("regexp_replace(q, '" + _WS + "+', ' ', 'g')")}), lambda q: q <> '') AS qs FROM {_ANS})
 SELECT row_id, qs[list_position(list_transform(qs, lambda q: length(q)), list_max(list_transform(qs, lambda q: length(q))))] AS quoted, nullif({_strip("regexp_extract(prompt, '(?s)^[^:]*:[\\s]+(.*)$', 1)")}, '') AS payload FROM x"""
)
def prompt_payloads(spark, d):
    """The text that a prompt hands over: its longest quotation, what stands behind its colon."""
    return answers(spark, d).select("row_id", T.longest_quoted("prompt").alias("quoted"), T.after_colon("prompt").alias("payload"))


@query(f"SELECT row_id, CASE WHEN json_valid(c) THEN json_type(c) = 'OBJECT' ELSE coalesce(json_valid(regexp_extract(c, '(?s)\\{{.*\\}}')), false) END AS has_object FROM (SELECT row_id, 'Result: ' || constraints || ' Done.' AS c FROM {_CP} WHERE constraints IS NOT NULL)")
def json_from_text(spark, d):
    """Whether a text around a JSON object yields it."""
    t = one_delivery(table(spark, d, "code_prompts")).where("constraints IS NOT NULL").select("row_id", F.concat(F.lit("Result: "), "constraints", F.lit(" Done.")).alias("c"))
    return t.select("row_id", T.json_object("c").isNotNull().alias("has_object"))


@query(
    f"""SELECT row_id, md5(regexp_replace(t, '\\A<reponame>[^\\n]*(\\n|\\z)', '')) AS headless, md5(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[\\x00\\x0b\\x0c]', '', 'g')) AS minimal,
 md5({_strip(f"regexp_replace(t, '{_WS}+', ' ', 'g')")}) AS collapsed, md5(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '^\\n+', ''), '{_WS}+$', '')) AS indented, ext IN ('py', 'pyw') AS allowed FROM {_CODE}"""
)
def code_forms(spark, d):
    """Normal forms of code files (one keeps indentation, one destroys it) and the extensions allowed."""
    t = one_delivery(table(spark, d, "code_files")).where("text IS NOT NULL")
    ext = F.lower(F.regexp_extract("meta.path", r"\.([^./]+)$", 1))
    return t.select("row_id", F.md5(T.without_header("text")).alias("headless"), F.md5(T.minimal_normal("text")).alias("minimal"), F.md5(T.collapse("text")).alias("collapsed"), F.md5(T.code_keep_normal("text")).alias("indented"), ext.isin("py", "pyw").alias("allowed"))


@query(
    f"""SELECT row_id, md5(translate(t, '“”„‟«»‘’‚‛', '\"\"\"\"\"\"''''''''')) AS quotes, (t <> '' AND length(t) BETWEEN 40 AND 4000) AS reasonable, round(1000 * len(regexp_extract_all(t, 'https?://\\S+')) / greatest(length(t), 1)::DOUBLE, 9) AS urls
 FROM (SELECT doc_id AS row_id, text AS t FROM documents WHERE text IS NOT NULL)"""
)
def text_forms(spark, d):
    """Quotes in ASCII, reasonable lengths, addresses a thousand characters."""
    t = docs(spark, d).where("text IS NOT NULL")
    return t.select("row_id", F.md5(T.ascii_quotes("text")).alias("quotes"), F.when(F.length("text").between(40, 4000), True).otherwise(False).alias("reasonable"), F.round(T.urls_per_thousand("text"), 9).alias("urls"))


@query(f"SELECT 'code' AS part, row_id, canonical_prompt AS prompt, family, NULL::VARCHAR AS author FROM {_CP} UNION ALL SELECT 'general', row_id, canonical_prompt, family, meta.author FROM {_GEN}")
def union_parts(spark, d):
    """Part files under one schema; what a part lacks is null."""
    code = one_delivery(table(spark, d, "code_prompts")).select(F.lit("code").alias("part"), "row_id", F.col("canonical_prompt").alias("prompt"), "family")
    general = _prompts(spark, d).select(F.lit("general").alias("part"), "row_id", F.col("canonical_prompt").alias("prompt"), "family", F.col("meta.author").alias("author"))
    return code.unionByName(general, allowMissingColumns=True)


@query()
def prompt_dedup_cascade(spark, d):
    """Prompts kept by the cascade: exact by their key, then near-same (0.8 of five-word shingles) within a subfamily."""
    t = _prompts(spark, d).where("raw_prompt IS NOT NULL").select("row_id", F.coalesce("subfamily", F.lit("")).alias("subfamily"), T.prompt_key("raw_prompt").alias("k"))
    exact = cut(rows.first_of(cut(t), [F.col("subfamily"), F.col("k")]))
    near = rows.similar_pairs(exact.withColumn("s", T.shingles("k", 5)), "s", 0.8, "subfamily")
    return rows.greedy_keep(near, exact.select("row_id"))


# -- layouts and files -----------------------------------------------------------------------------------
@query(
    """WITH x AS (SELECT doc_id, source, coalesce(n_chars, 0) AS n, coalesce(sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents), s AS (SELECT *, CASE WHEN b < 5000 THEN 'val' ELSE 'train' END AS split FROM x),
 r AS (SELECT split, CASE WHEN split = 'val' THEN source END AS part, n, coalesce(sum(n) OVER (PARTITION BY split, CASE WHEN split = 'val' THEN coalesce(source, '') END ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s)
 SELECT split, part, sum(n)::BIGINT AS chars, (max(o + greatest(n - 1, 0)) // 20000 + 1)::BIGINT AS shards FROM r GROUP BY ALL"""
)
def split_shards(spark, d):
    """Shards of 20,000 characters: training ones over all sources, validation ones for each source."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", F.coalesce("n_chars", F.lit(0)).alias("n"))
    routed = cut(rows.route_val_first(t, ["source"], F.col("n"), F.lit(5000)).withColumn("part", F.when(F.col("split") == "val", F.col("source"))))
    laid = rows.shards(routed, ["split", "part"], F.col("n"), 20_000)
    return laid.groupBy("split", "part").agg(F.sum("n").alias("chars"), (F.max("last_shard") + 1).cast("long").alias("shards"))


@query(
    """WITH s AS (SELECT doc_id AS shard, coalesce(n_chars, 0) // 100 AS blocks FROM documents WHERE n_chars >= 100), r AS (SELECT shard, sum(blocks) OVER (ORDER BY shard) - blocks AS lo, sum(blocks) OVER (ORDER BY shard) - 1 AS hi FROM s)
 SELECT b.block, shard, (b.block - lo)::BIGINT AS "offset" FROM (SELECT (doc_id * 7)::BIGINT AS block FROM documents) b JOIN r ON b.block BETWEEN lo AND hi"""
)
def block_lookup(spark, d):
    """The shard of a global block number, over shards of different lengths."""
    t = table(spark, d, "documents")
    runs = quotas.sized_runs(t.where("n_chars >= 100").select(F.col("doc_id").alias("shard"), F.floor(F.col("n_chars") / 100).alias("blocks")), [])
    return quotas.locate(t.select((F.col("doc_id") * 7).alias("block")), runs, 64).select("block", "shard", F.col("offset").cast("long").alias("offset"))


_CHARS = "(SELECT sum(n_chars)::BIGINT AS n FROM documents WHERE n_chars > 0)"


@query(f"SELECT i::BIGINT AS shard, least(50000, n - i * 50000)::BIGINT AS tokens FROM {_CHARS}, LATERAL (SELECT unnest(range(0, ((n + 49999) // 50000)::BIGINT)) AS i)")
def shard_files(spark, d):
    """Packed shards of 50,000 ids (here code points) written to the shared folder and read back."""
    t = docs(spark, d).where(F.length("text") > 0).select("row_id", F.transform(F.split("text", "(?s)(?<=.)(?=.)"), lambda c: F.ascii(c)).alias("ids"))
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    jsonl.write_shards(cut(t), "ids", folder, 0x110000, 50_000).count()
    got = jsonl.read_shards(spark, f"{folder}/*.bin", 10_000, wide=True, keep_rest=True)
    shard = F.regexp_extract("path", r"shard_(\d+)\.bin", 1).cast("long")
    return got.groupBy(shard.alias("shard")).agg(F.sum(F.size("ids")).alias("tokens"))


@query(
    f"SELECT 'ok' AS reason, count(*) AS n FROM {_GEN} WHERE length(raw_prompt) > 0 UNION ALL SELECT 'empty', count(*) FROM {_GEN} WHERE raw_prompt = '' HAVING count(*) > 0 UNION ALL SELECT 'non_str', count(*) FROM {_GEN} WHERE raw_prompt IS NULL HAVING count(*) > 0"
)
def lines_roundtrip(spark, d):
    """Prompts as JSON lines in the shared folder, read back tolerantly with a reason for each bad line."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    jsonl.write_lines(_prompts(spark, d).select("row_id", F.col("raw_prompt").alias("text"), F.lit(1).alias("_internal")), folder)
    return jsonl.read_text_lines(spark, folder).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Hourly counts by a stream over the events that runs until it has read all of them."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return streams.run_to_end(streams.windowed_counts(source, "ts", "event_type", late=None), folder)


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
