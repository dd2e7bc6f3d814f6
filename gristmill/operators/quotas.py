"""Quotas, targets, splits by whole groups, and epochs over DataFrames with a stable ``row_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import spread_join
from .rows import running_total, seeded


def bucket_targets(config: DataFrame, total: int, val_ratio: float, val_min: int) -> DataFrame:
    """Training and validation targets of ``bucket, name, bucket_share, weight, upsample`` rows (configuration).

    A source's training target is its part of its bucket's part of ``total``, times ``upsample``; validation
    gets the same proportions of ``total * val_ratio``, but at least ``val_min``. Sources without a positive
    weight are left out.
    """
    used = config.where(F.col("weight") > 0)
    bucket = F.floor(F.lit(total) * F.col("bucket_share"))
    up = F.coalesce(F.nullif("upsample", F.lit(0.0)), F.lit(1.0))
    train = used.withColumn("train_target", F.floor(bucket * F.col("weight") * up).cast("long"))
    whole = F.greatest(F.sum("train_target").over(W.partitionBy()), F.lit(1))  # a table of configuration
    val = F.floor(F.lit(int(total * val_ratio)) * (F.col("train_target") / whole)).cast("long")
    return train.withColumn("val_target", F.greatest(val, F.lit(val_min)))


def epochs(df: DataFrame, by: str, size: str, quota: DataFrame, row_id: str = "row_id") -> DataFrame:
    """How often each row is used so that a source comes to its ``quota``: whole passes over the source, and
    once more the rows in order until the quota is reached (the row that reaches it included).

    ``quota`` has one row for each value of ``by`` (column ``quota``). Rows of sources without a quota are left out;
    a source without any size gives nothing.
    """
    supply = df.groupBy(by).agg(F.sum(size).alias("__supply"))
    plan = quota.join(supply, by).where(F.col("__supply") > 0)
    plan = plan.select(by, F.floor(F.col("quota") / F.col("__supply")).alias("__whole"), (F.col("quota") - F.floor(F.col("quota") / F.col("__supply")) * F.col("__supply")).alias("__rest"))
    run = running_total(df, [by], F.col(size), "__before", row_id)
    used = run.join(F.broadcast(plan), by)  # one row a source of the configuration
    times = F.col("__whole") + (F.col("__before") < F.col("__rest")).cast("long")
    return used.withColumn("times", times).where(F.col("times") > 0).drop("__before", "__whole", "__rest")


def val_sizes(df: DataFrame, by: str, ratio: float, least: int) -> DataFrame:
    """Validation rows of each source: at least ``least`` or its ratio, never more than a fifth and one."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("n_val", F.least(F.greatest(F.lit(least), F.floor(F.col("n") * ratio)), F.floor(F.col("n") / 5) + 1).cast("long"))


def top_of_groups(df: DataFrame, by: list[str], order: list[Column], most: int, row_id: str = "row_id", parts: int = 64) -> DataFrame:
    """The first ``most`` rows of each group, with their ``rank``: each of ``parts`` parts of a group is cut to
    ``most`` rows first, so no task sorts a whole group."""
    keys = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    slim = df.select(*by, row_id, *keys).withColumn("__part", F.pmod(F.xxhash64(row_id), F.lit(parts)))
    by_order = [F.col(f"__o{i}") for i in range(len(order))] + [F.col(row_id)]
    first = slim.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*by_order))).where(F.col("__r") <= most)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*by_order))).where(F.col("rank") <= most)
    return df.join(best.select(row_id, "rank"), row_id)


def quotas_with_topup(df: DataFrame, by: str, quotas: dict[str, int], total: int, order: str = "row_id") -> DataFrame:
    """Up to its quota of every named source, then rows that were left over, in order, until ``total``.

    Ranks are running counts, so no task sees a whole source.
    """
    spark = df.sparkSession
    named = F.broadcast(spark.createDataFrame(list(quotas.items()), "__name string, __quota long"))  # configuration
    ranked = running_total(df.withColumn("__name", F.coalesce(F.col(by), F.lit(""))), ["__name"], F.lit(1), "__rank", order)
    flagged = ranked.join(named, "__name", "left").withColumn("first_choice", F.col("__rank") < F.coalesce("__quota", F.lit(0)))
    placed = running_total(flagged, ["first_choice"], F.lit(1), "__place", order)
    n_first = flagged.where("first_choice").count()
    limit = F.when(F.col("first_choice"), F.lit(total)).otherwise(F.lit(max(0, total - n_first)))
    return placed.where(F.col("__place") < limit).drop("__name", "__quota", "__rank", "__place")


def family_quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rounded proportional quotas in the order of names, the rest to the last, then one more each in turn while
    rows are left and the total isn't reached. A table of one row a family."""
    names, available = sorted(counts), sum(counts.values())
    if not names or total >= available:
        return dict(counts)
    out, left = {}, total
    for f in names[:-1]:
        out[f] = min(round(total * counts[f] / available), counts[f])
        left -= out[f]
    out[names[-1]] = max(0, min(left, counts[names[-1]]))
    while sum(out.values()) < total:
        spare = [f for f in names if out[f] < counts[f]]
        if not spare:
            break
        for f in spare[: total - sum(out.values())]:
            out[f] += 1
    return out


def groups_to_val(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """Whole groups, in seeded order, go to val until the next one would pass the target; at least one does.

    Returns ``group, n, split``. The order is a hash, so the running sum goes by ranges of it.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    target = min(max(1, round(total * ratio)), max(1, total - 1))
    ordered = sizes.withColumn("__h", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group))), 1, 15), 16, 10).cast("long"))
    run = running_total(ordered, [], F.col("n"), "__before", "__h")
    # the first group that would pass the target ends the choice, whatever stands behind it
    stop = run.where((F.col("__before") > 0) & (F.col("__before") + F.col("n") > target) | (F.col("__before") >= target)).agg(F.min("__before")).first()[0]
    inside = F.lit(True) if stop is None else F.col("__before") < stop
    return run.withColumn("split", F.when(inside, "val").otherwise("train")).drop("__h", "__before")


def with_group_split(df: DataFrame, splits: DataFrame, group: str) -> DataFrame:
    """Every row with its group's split."""
    return spread_join(df, splits.select(group, "split"), group)


def sized_runs(shards: DataFrame, by: list[str]) -> DataFrame:
    """First and last block of every shard of ``shard, blocks`` rows in order (one row a shard)."""
    run = running_total(shards, by, F.col("blocks"), "first_block", "shard")
    return run.withColumn("last_block", F.col("first_block") + F.col("blocks") - 1)


def locate(blocks: DataFrame, runs: DataFrame, step: int) -> DataFrame:
    """The shard and the place in it of every global ``block``: both sides meet in bins of ``step`` blocks, so the
    range condition is checked within equal bins only."""
    bins = runs.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("first_block") / step), F.floor(F.col("last_block") / step))))
    got = blocks.withColumn("__bin", F.floor(F.col("block") / step)).join(bins, "__bin")
    return got.where(F.col("block").between(F.col("first_block"), F.col("last_block"))).withColumn("offset", F.col("block") - F.col("first_block")).drop("__bin")


def seeded_cap(df: DataFrame, by: list[str], most: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """A seeded sample of at most ``most`` rows of each group (the feature is the sample)."""
    return top_of_groups(df, by, [seeded(seed, row_id)], most, row_id).drop("rank")
