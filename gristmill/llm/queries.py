"""The pN_ queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, table
from . import group_queries, p1_parse, p2_pairs, p6_packing, p7_mixing, p8_sentences
from ..functions.tokens import with_token_count


def _p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    files = p1_parse.parse_check(
        table(spark, d, "code_files"),
        "text",
        p1_parse.language_of(F.col("meta.path")),
        [F.lit("code_files").alias("table_name"), F.col("row_id"), F.col("meta.repo_name").alias("repo_name")],
    )
    prompts = p1_parse.parse_check(
        table(spark, d, "code_prompts"),
        "reference_code",
        F.lit("python"),
        [F.lit("code_prompts").alias("table_name"), F.col("row_id"), F.lit(None).cast("string").alias("repo_name")],
    )
    return files.unionByName(prompts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_verdicts(spark, d).where(~F.col("parses")).select("table_name", "row_id").distinct()


def p1_failures(spark: SparkSession, d: str) -> DataFrame:
    """Where and why each invalid file fails."""
    bad = _p1_verdicts(spark, d).where(~F.col("parses"))
    return bad.dropDuplicates(["table_name", "row_id"]).drop("parses")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of invalid files per table, repository and language; a record delivered twice counts once."""
    return p1_parse.rates(_p1_verdicts(spark, d).dropDuplicates(["table_name", "row_id"]), ["table_name", "repo_name", "language"])


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs.defects(table(spark, d, "teacher_answers"), "prompt", "answer_raw")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("row_id", "defect")


def p2_all_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect of every bad pair."""
    return _p2(spark, d).select("row_id", F.explode("defects").alias("defect"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return cut(with_token_count(table(spark, d, "documents").select("doc_id", "source", "text")))


def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in table(spark, d, "pack_sizes").select("pack_name", "capacity_tokens").collect()]


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    return p6_packing.pack(_sizes(spark, d), _packs(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    packs = _packs(spark, d)
    return p6_packing.report(p6_packing.pack(_sizes(spark, d), packs), packs)


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every document's tokens lie in blocks once, in as few pieces as the capacity
    allows, and no block holds more than its capacity (exact by arithmetic, for each capacity)."""
    sizes, packs = _sizes(spark, d), _packs(spark, d)
    blocks = cut(p6_packing.pack(sizes, packs))
    caps = F.broadcast(spark.createDataFrame(packs, "pack_name string, cap int"))
    per_doc = blocks.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum(F.col("to_token") - F.col("from_token")).alias("placed"))
    wrong = per_doc.join(caps, "pack_name").join(sizes, "doc_id").where((F.col("placed") != F.col("n_tokens")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("cap")))))
    over = blocks.groupBy("pack_name", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("fill")).join(caps, "pack_name").where("fill > cap")
    bad = wrong.groupBy("pack_name").agg(F.count("*").alias("wrong_documents")).join(over.groupBy("pack_name").agg(F.count("*").alias("over_full")), "pack_name", "full")
    placed = per_doc.groupBy("pack_name").agg(F.count("*").alias("documents"))
    return placed.join(bad, "pack_name", "left").select("pack_name", "documents", F.coalesce("wrong_documents", F.lit(0)).alias("wrong_documents"), F.coalesce("over_full", F.lit(0)).alias("over_full"))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mixture: no document twice, none used more often than its source allows."""
    mixture, _, _, targets = _mix(spark, d)
    most = F.broadcast(spark.createDataFrame([(s, m) for s, _, m in targets], "source string, most int"))
    per = mixture.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("different"), F.max("times").alias("times"))
    return per.join(most, "source").agg(F.sum((F.col("rows") != F.col("different")).cast("long")).alias("repeated"), F.sum((F.col("times") > F.col("most")).cast("long")).alias("too_often"))


def _mix(spark: SparkSession, d: str) -> tuple:
    targets = [(r[0], r[1], r[2]) for r in table(spark, d, "mix_targets").select("source", "target_weight", "max_repeats").collect()]
    return (*p7_mixing.mix(_sizes(spark, d), targets), targets)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].drop("stage")


def p7_stages(spark: SparkSession, d: str) -> DataFrame:
    """Where the documents of the mixture were decided: flights, landing, or all of a source alike."""
    return _mix(spark, d)[0].groupBy("stage").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares against the targets."""
    return p7_mixing.shares(*_mix(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_sentences.split_documents(table(spark, d, "documents"))


def p8_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units per source and language value: documents, units, mean length."""
    docs = table(spark, d, "documents")
    units = p8_sentences.split_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"))
    return (
        docs.select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"))
        .join(units, "doc_id", "left")
        .groupBy("source", "lang")
        .agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.round(F.sum("chars") / F.sum("n"), 4).alias("mean_chars"))
    )


def queries() -> dict:
    return group_queries.queries() | {f.__name__: f for f in (p1_found, p1_failures, p1_rates, p2_found, p2_all_defects, p6_blocks, p6_report, p6_documents, p7_limits, p7_mixture, p7_stages, p7_shares, p8_found, p8_units)}


def oracle_sql() -> dict[str, str]:
    packed = "SELECT pack_name, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0 AS wrong_documents, 0 AS over_full FROM pack_sizes"
    return group_queries.oracle_sql() | {"p6_documents": packed, "p7_limits": "SELECT 0 AS repeated, 0 AS too_often"}
