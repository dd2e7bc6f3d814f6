"""Deduplication, windows, quotas, splits and reports over DataFrames with a stable ``row_id``."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut, hot_keys, prefix_sum, salted_join, spread_join
from ..functions import text as T

# -- deduplication ---------------------------------------------------------------------------------------


def first_of(df: DataFrame, key: list[Column], row_id: str = "row_id") -> DataFrame:
    """The first row of each key. Keys are hashed and the minimum is found by partial aggregation, so a hot
    key costs no task more than others; only kept ids are joined back."""
    hashed = df.withColumn("__k", F.md5(F.array_join(F.array(*[F.coalesce(k.cast("string"), F.lit("\0")) for k in key]), "\x1f")))
    first = hashed.groupBy("__k").agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(first, row_id, "left_semi")


def audit(df: DataFrame, key: Column, row_id: str = "row_id") -> DataFrame:
    """Every row and the first row of its key (``duplicate_of`` null for firsts)."""
    keyed = cut(df.withColumn("__k", key))  # the key is worked out once
    first = keyed.groupBy("__k").agg(F.min(row_id).alias("__first"))
    return spread_join(keyed, first, "__k").withColumn("duplicate_of", F.when(F.col("__first") != F.col(row_id), F.col("__first"))).drop("__k", "__first")


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier output has (null keys are kept)."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def across_splits(df: DataFrame, key: Column, rank: Column, row_id: str = "row_id") -> DataFrame:
    """One row for each key over all splits: the split of least rank, then the first row."""
    keyed = df.withColumn("__k", key).withColumn("__r", F.struct(rank.cast("int").alias("r"), F.col(row_id).alias("i")))
    best = keyed.groupBy("__k").agg(F.min("__r")["i"].alias(row_id)).select(row_id)
    return df.join(best, row_id, "left_semi")


def similar_pairs(df: DataFrame, shingles: str, threshold: float, block: str | None = None, row_id: str = "row_id") -> DataFrame:
    """Pairs ``a < b`` of rows with Jaccard similarity of at least ``threshold``, by prefix filter.

    Shingles are ordered by frequency, rare first; two sets this similar share one of their first
    n - ceil(threshold * n) + 1 shingles. Exact; identical sets are one class whose members pair with the
    class's first row (column ``exact``). Rows without shingles match nothing.
    """
    cols = [row_id, *([block] if block else [])]
    sets = df.where(F.size(shingles) > 0).withColumn("__h", F.array_sort(F.transform(F.col(shingles), lambda s: F.xxhash64(s))))
    sets = sets.withColumn("__blk", F.col(block).cast("string") if block else F.lit("")).withColumn("__k", F.md5(F.concat_ws(",", F.coalesce("__blk", F.lit("\0")), F.transform("__h", lambda h: h.cast("string")))))
    sets = cut(sets.select(*cols, "__blk", "__h", "__k"))  # shingles are hashed once
    first = sets.groupBy("__k").agg(F.min(row_id).alias("__first"))
    members = spread_join(sets.select(*cols, "__k"), first, "__k").where(F.col(row_id) != F.col("__first"))
    reps = sets.join(first.select(F.col("__first").alias(row_id)), row_id, "left_semi").select(row_id, "__blk", "__h")
    tokens = reps.select(row_id, "__blk", F.size("__h").alias("n"), F.explode("__h").alias("g"))
    counts = tokens.groupBy("g").agg(F.count("*").alias("f"))
    hot = hot_keys(counts, "g", "f")
    ranked = salted_join(tokens, counts, "g", hot).groupBy(row_id, "__blk", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))
    post = ranked.select(row_id, "__blk", "n", F.explode(F.transform(prefix, lambda x: x["g"])).alias("g"))
    x, y = post.alias("x"), post.alias("y")
    on = (F.col("x.g") == F.col("y.g")) & F.col("x.__blk").eqNullSafe(F.col("y.__blk")) & (F.col(f"x.{row_id}") < F.col(f"y.{row_id}"))
    on = on & (F.col("x.n") >= F.col("y.n") * threshold - 1e-9) & (F.col("y.n") >= F.col("x.n") * threshold - 1e-9)
    cand = x.join(y, on).select(F.col(f"x.{row_id}").alias("a"), F.col(f"y.{row_id}").alias("b")).distinct()
    full = reps.select(row_id, "__h")
    checked = cand.join(full.select(F.col(row_id).alias("a"), F.col("__h").alias("ha")), "a").join(full.select(F.col(row_id).alias("b"), F.col("__h").alias("hb")), "b")
    near = checked.withColumn("similarity", F.round(T.jaccard(F.col("ha"), F.col("hb")), 6)).where(T.jaccard(F.col("ha"), F.col("hb")) >= threshold)
    exact = members.select(F.col("__first").alias("a"), F.col(row_id).alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    return near.select("a", "b", "similarity", F.lit(False).alias("exact")).unionByName(exact)


#: At most this many pairs among open rows are settled in one task.
SMALL_PAIRS = 500_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that the greedy rule drops, row by row."""
    earlier, kind = defaultdict(list), None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            earlier[b].append(a)
    dropped: set = set()
    for b in sorted(earlier):
        if any(a not in dropped for a in earlier[b]):
            dropped.add(b)
    if dropped:
        yield pa.RecordBatch.from_arrays([pa.array(sorted(dropped), kind)], names=["v"])


def greedy_keep(pairs: DataFrame, rows: DataFrame, row_id: str = "row_id", small_pairs: int = SMALL_PAIRS) -> DataFrame:
    """Rows kept by the greedy rule: keep a row unless a kept earlier row is similar to it.

    Each round keeps the rows without an open earlier neighbour, at least the smallest, and drops their
    neighbours; when at most ``small_pairs`` pairs are left among open rows, one task settles them in order.
    Rounds go on until no pair is open, so the result equals the sequential rule.
    Pairs marked ``exact`` link a class of copies to its first row only (see :func:`similar_pairs`): what
    drops the first row drops its copies too, and else the first row does, so they never stay.
    """
    exact = F.col("exact") if "exact" in pairs.columns else F.lit(False)
    pairs = cut(pairs.select("a", "b", exact.alias("exact")))
    dropped = pairs.where("exact").select(F.col("b").alias("v")).distinct()
    edges, done = pairs.where("NOT exact").select("a", "b"), 0
    while n := edges.count():
        if n <= small_pairs:
            gone = cut(edges.coalesce(1).mapInArrow(_settle, f"v {edges.schema['a'].dataType.simpleString()}"))
            dropped = dropped.unionByName(gone)
            break
        first = edges.select(F.col("a").alias("v")).distinct().join(edges.select(F.col("b").alias("v")), "v", "left_anti")
        gone = cut(edges.join(first.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).distinct())
        edges = cut(edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"))
        dropped, done = dropped.unionByName(gone), done + 1
        if done % 16 == 0:
            dropped = cut(dropped)  # the plan stays short
    return rows.join(dropped.withColumnRenamed("v", row_id), row_id, "left_anti")


# -- order, ranks, quotas --------------------------------------------------------------------------------
def seeded(seed: int, row_id: str = "row_id") -> Column:
    """An order that is random but the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def ranked_within(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def best_of(df: DataFrame, by: list[str], order: list[Column], row_id: str = "row_id") -> DataFrame:
    """The best row of each group, by partial aggregation."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row_id).alias("id"))
    return df.join(df.groupBy(*by).agg(F.min(key)["id"].alias(row_id)).select(row_id), row_id, "left_semi")


def running_total(df: DataFrame, by: list[str], value: Column, out: str, row_id: str = "row_id") -> DataFrame:
    """Exclusive running sum in ``row_id`` order within ``by``: ids are cut into ranges, the totals of the
    ranges are summed first and rows only ordered within their range, so no task sees a whole group."""
    lo, hi = df.agg(F.min(row_id), F.max(row_id)).first()
    if lo is None:
        return df.withColumn(out, F.lit(0))
    width = max(1, (hi - lo) // 4096 + 1)
    keyed = df.withColumn("__b", F.floor((F.col(row_id) - lo) / width)).withColumn("__v", value)
    totals = keyed.groupBy(*by, "__b").agg(F.sum("__v").alias("__t"))
    w = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__start"))
    on = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inner = W.partitionBy(*by, "__b").orderBy(row_id).rowsBetween(W.unboundedPreceding, -1)
    return keyed.join(before, on).withColumn(out, F.col("__start") + F.coalesce(F.sum("__v").over(inner), F.lit(0))).drop("__b", "__v", "__kb", "__start", *[f"__k{i}" for i in range(len(by))])


def fill_budget(df: DataFrame, by: list[str], size: Column, budget: Column) -> DataFrame:
    """Rows in order until a group's budget is reached; the row that crosses it is kept."""
    return running_total(df, by, size, "__before").where(F.col("__before") < budget).drop("__before")


def route_val_first(df: DataFrame, by: list[str], size: Column, val_target: Column) -> DataFrame:
    """The first rows of each source, up to its validation target, go to val."""
    return running_total(df, by, size, "__before").withColumn("split", F.when(F.col("__before") < val_target, "val").otherwise("train")).drop("__before")


def shards(df: DataFrame, by: list[str], size: Column, shard_size: int) -> DataFrame:
    """First and last shard of each row's tokens."""
    run = running_total(df, by, size, "__before").withColumn("__s", size)
    return run.withColumn("first_shard", F.floor(F.col("__before") / shard_size)).withColumn("last_shard", F.floor((F.col("__before") + F.greatest(F.col("__s") - 1, F.lit(0))) / shard_size)).drop("__before", "__s")


def split_exact(df: DataFrame, ratio: float, seed: int, by: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """An exact share of rows to val, by a seeded hash order (a distributed running count)."""
    ordered = prefix_sum(df, by or [], F.xxhash64(F.lit(seed), row_id), F.lit(1), "__rank", tie=row_id)
    total = df.groupBy(*(by or [])).agg(F.floor(F.count("*") * ratio).alias("__n"))
    joined = ordered.join(F.broadcast(total), by) if by else ordered.crossJoin(F.broadcast(total))
    return joined.withColumn("split", F.when(F.col("__rank") < F.col("__n"), "val").otherwise("train")).drop("__rank", "__n")


def sample_exact(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """A seeded sample of n rows (the feature is the sample): bottom-n of a hash, by TakeOrdered."""
    return df.join(F.broadcast(df.select(row_id, seeded(seed, row_id).alias("__o")).orderBy("__o").limit(n).select(row_id)), row_id, "left_semi")


def shuffled(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(seeded(seed, row_id), row_id)


def largest_remainder(weights: DataFrame, total: int, name: str = "source", weight: str = "weight") -> DataFrame:
    """Whole quotas that add up to ``total``; the largest fractions get the rest, ties to the later name.

    One row per source: a small table."""
    share = F.col(weight) / F.sum(weight).over(W.partitionBy())
    raw = weights.withColumn("__raw", F.round(share * total, 9)).withColumn("__floor", F.floor("__raw"))
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("__raw") - F.col("__floor"), 9)), F.desc(name)))
    left = total - F.sum("__floor").over(W.partitionBy())
    return raw.withColumn("__rank", rank).withColumn("quota", F.col("__floor") + F.when(F.col("__rank") <= left, 1).otherwise(0)).drop("__raw", "__floor", "__rank")


def spread_first(df: DataFrame, group: Column, seed: int, row_id: str = "row_id") -> DataFrame:
    """Rank that takes one row of every group before second ones."""
    g = df.withColumn("__g", group).withColumn("__n", F.row_number().over(W.partitionBy("__g").orderBy(row_id)))
    return g.withColumn("round", F.when(F.col("__n") == 1, 0).otherwise(1)).drop("__g", "__n")


# -- reports ---------------------------------------------------------------------------------------------
def counter(df: DataFrame, by: list[str], row_id: str = "row_id") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(row_id).alias("first_seen"))


def nearest_rank(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """Quantiles by nearest rank round((n - 1) q), half to even, from value counts (no list of all values)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    edges = running_total(counts.withColumn("__id", F.col(value).cast("long")), [], F.col("c"), "__from", "__id")
    total = F.broadcast(counts.agg(F.sum("c").alias("__n")))
    want = df.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    at = F.broadcast(want.crossJoin(total).withColumn("__at", F.bround((F.col("__n") - 1) * F.col("q"), 0).cast("long")))
    return edges.join(at, (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__from") + F.col("c"))).select("q", F.col(value).alias("value"))


def windows_of(t: Column, width: int, step: int) -> Column:
    last = F.length(t) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.md5(F.substr(t, i + 1, F.lit(width)))))


def duplicate_rate(hashes: DataFrame, key: str = "h") -> DataFrame:
    """Blocks, different blocks and the share of extra copies."""
    n = hashes.groupBy(key).agg(F.count("*").alias("c"))
    return n.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("blocks"), F.count("*").alias("different"), F.round(F.sum(F.col("c") - 1) / F.sum("c"), 9).alias("duplicate_rate"))


def advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-4) -> DataFrame:
    """Rewards centred and scaled within their group, from group aggregates."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"))
    return spread_join(df, stats, group).withColumn("advantage", F.round((F.col(reward) - F.col("__m")) / (F.col("__s") + eps), 9)).drop("__m", "__s")


def diversity(df: DataFrame, group: str, vector: str, row_id: str = "row_id") -> DataFrame:
    """One minus the mean cosine to the other vectors of the group, in linear time: the mean of the cosines
    is a product with the sum of the unit vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = df.withColumn("__u", F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))
    sums = unit.select(group, F.posexplode("__u").alias("p", "x")).groupBy(group, "p").agg(F.sum("x").alias("x")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("__sum"))
    sums = sums.join(df.groupBy(group).agg(F.count("*").alias("__n")), group)
    dot = F.aggregate(F.zip_with("__u", "__sum", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    own = F.aggregate("__u", F.lit(0.0), lambda a, x: a + x * x)
    joined = spread_join(unit, sums, group)
    return joined.withColumn("diversity", F.when(F.col("__n") > 1, 1 - (dot - own) / (F.col("__n") - 1)).otherwise(1.0)).drop("__u", "__sum", "__n")


def ema(values: Column, beta: float = 0.9) -> Column:
    """Exponential moving average of an array in order."""
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(beta * F.try_element_at(acc, F.lit(-1)) + (1 - beta) * x))))


def share_report(used: DataFrame, config: DataFrame, by: str, size: str, weight: str) -> DataFrame:
    """Size, share, weight and error of every configured source (one row each)."""
    all_of = W.partitionBy()
    joined = F.broadcast(config.select(by, weight)).join(used, by, "left").withColumn(size, F.coalesce(size, F.lit(0)).cast("long"))
    share, want = F.col(size) / F.sum(size).over(all_of), F.col(weight) / F.sum(weight).over(all_of)
    return joined.select(by, F.round(want, 9).alias("weight"), size, F.round(share, 9).alias("share"), F.round(share - want, 9).alias("error"))


def key_match(df: DataFrame, group: str, key: str, numbers: str, row_id: str = "row_id") -> DataFrame:
    """How each row matches the first row of its group: ``text``, ``numbers`` (the same, in order) or ``no``."""
    first = df.groupBy(group).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(numbers).alias("n")), row_id).alias("__first"))
    joined = spread_join(df, first, group)
    same = (F.size(numbers) > 0) & (F.col(numbers) == F.col("__first.n"))
    return joined.select(row_id, F.when(F.col(key) == F.col("__first.k"), "text").when(same, "numbers").otherwise("no").alias("matched"))
