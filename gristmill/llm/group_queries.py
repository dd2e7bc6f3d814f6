"""The pN_ queries of copies, related records and overlaps across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, one_delivery, spread_join, table
from . import p3_copies, p4_related, p5_overlap


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return p3_copies.copies(table(spark, d, "code_prompts"), "canonical_prompt", ["canonical_prompt", "entry_point"], ["constraints"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = _copies(spark, d).where(F.col("keep_id") < F.col("row_id"))
    return got.select("keep_id", F.col("row_id").alias("copy_id"))


def p3_tasks(spark: SparkSession, d: str) -> DataFrame:
    """One row per task with its number of copies; rows with a null prompt stand for themselves."""
    groups = _copies(spark, d)
    sizes = groups.groupBy("keep_id").agg(F.count("*").alias("copies"))
    later = groups.where(F.col("keep_id") < F.col("row_id")).select("row_id")
    rows = one_delivery(table(spark, d, "code_prompts").select("row_id", "canonical_prompt", "entry_point", "constraints"))
    kept = rows.join(later, "row_id", "left_anti")
    return kept.join(sizes.withColumnRenamed("keep_id", "row_id"), "row_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def _p4_keys() -> list:
    return [[F.col("meta.author")], [F.col("meta.parent_seed_id")], [F.col("source"), F.col("source_key")]]


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r[0], r[1]) for r in table(spark, d, "split_targets").orderBy(F.desc("target_share"), "split_name").collect()]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = p4_related.related(table(spark, d, "general_prompts"), _p4_keys())
    return got.where(F.col("group_id") < F.col("row_id")).select("group_id", "row_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row's group and split."""
    got = p4_related.split_rows(table(spark, d, "general_prompts"), _p4_keys(), "family", _targets(spark, d))
    return got.select("row_id", "group_id", F.col("stratum").alias("family"), "split_name")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row's group and family, and whether the group has one split: what must hold of any valid assignment."""
    got = p4_splits(spark, d)
    per = got.groupBy("group_id").agg((F.min("split_name") == F.max("split_name")).alias("whole"))
    return spread_join(cut(got.drop("split_name")), per, "group_id").select("row_id", "group_id", "family", "whole")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares against the targets, per family and over all rows."""
    targets = _targets(spark, d)
    got = p4_related.split_rows(table(spark, d, "general_prompts"), _p4_keys(), "family", targets)
    return p4_related.split_report(got, targets).withColumnRenamed("stratum", "family")


def _p5(spark: SparkSession, d: str) -> tuple:
    mix = table(spark, d, "sft_mix")
    return (mix, *p5_overlap.cross_split(mix, F.col("messages"), F.col("meta.split")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, evals, trains = _p5(spark, d)
    return p5_overlap.row_pairs(pairs, evals, trains)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per split and dataset."""
    mix, pairs, evals, trains = _p5(spark, d)
    return p5_overlap.overlap_report(mix, pairs, evals, trains, F.col("meta.split"), F.col("meta.dataset"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_tasks, p4_found, p4_splits, p4_groups, p4_report, p5_found, p5_report)}


_P3 = """WITH r AS (SELECT row_id, canonical_prompt AS p, entry_point AS e, "constraints" AS c FROM code_prompts WHERE canonical_prompt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1),
 k AS (SELECT row_id, regexp_replace(lower(p), '[^\\p{L}\\p{N}]', '', 'g') AS kp, regexp_replace(lower(coalesce(e, '')), '[^\\p{L}\\p{N}]', '', 'g') AS ke,
 CASE WHEN c IS NULL THEN NULL ELSE (SELECT list_sort(list(fullkey || ' ' || type || ' ' || coalesce(atom::VARCHAR, ''))) FROM json_tree(c)) END AS kc FROM r),
 g AS (SELECT row_id, min(row_id) OVER (PARTITION BY kp, ke, kc) AS keep_id FROM k) """


def _key(*cols: str) -> str:
    clean = [f"regexp_replace(lower({c}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')" for c in cols]
    bad = "('', 'unknown', 'n/a', 'none', 'anonymous', '-')"
    return "CASE WHEN " + " AND ".join(f"{c} NOT IN {bad}" for c in clean) + " THEN " + " || chr(31) || ".join(clean) + " END"


_P4 = f"""WITH RECURSIVE k AS (SELECT DISTINCT row_id, 'a' AS kind, {_key("meta.author")} AS key FROM general_prompts UNION SELECT row_id, 's', {_key("meta.parent_seed_id")} FROM general_prompts
 UNION SELECT row_id, 'k', {_key("source", "source_key")} FROM general_prompts), e AS (SELECT DISTINCT a.row_id AS u, b.row_id AS v FROM k a JOIN k b USING (kind, key)),
 r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT min(v) AS group_id, u AS row_id FROM r GROUP BY u HAVING min(v) < u"""


def oracle_sql() -> dict[str, str]:
    tasks = (
        ", n AS (SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id), o AS (SELECT row_id, canonical_prompt, entry_point, \"constraints\" FROM code_prompts QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"
        " SELECT o.*, coalesce(copies, 1)::BIGINT AS copies FROM o LEFT JOIN n ON keep_id = row_id WHERE row_id NOT IN (SELECT row_id FROM g WHERE keep_id < row_id)"
    )
    splits = f"SELECT row_id, group_id, family FROM (SELECT DISTINCT ON (row_id) row_id, family FROM general_prompts) LEFT JOIN ({_P4}) USING (row_id)"
    return {
        "p4_found": _P4,
        "p4_groups": splits.replace("group_id, family FROM", "coalesce(group_id, row_id) AS group_id, family, true AS whole FROM"),
        "p3_found": _P3 + "SELECT keep_id, row_id AS copy_id FROM g WHERE keep_id < row_id",
        "p3_tasks": _P3 + tasks,
    }
