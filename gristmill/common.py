"""Building blocks shared by the operators: tables, lineage cuts, hot keys and distributed prefix sums."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this many rows and at least 1/HOT_SHARE of all rows, so there
#: are at most HOT_SHARE hot keys whatever the input: the list is safe to broadcast.
HOT_ROWS = 50_000
HOT_SHARE = 1_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    The folder is read from ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a
    temporary one and any other session an error: a folder of one machine is no place for a cluster's data.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, see :func:`cut`."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-"))
    return sc.getCheckpointDir()


def one_delivery(df: DataFrame, key: str = "row_id") -> DataFrame:
    """A record delivered twice counts once: one row per key (deliveries have the same content)."""
    return df.dropDuplicates([key])


def hot_keys(counts: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_ROWS, share: int = HOT_SHARE) -> DataFrame:
    """Keys with at least ``max(hot_rows, total / share)`` rows; never more than ``share`` of them."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("__total"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .where((F.col(n) >= hot_rows) & (F.col(n) * share >= F.col("__total")))
        .select(key)
    )


def salted_join(
    rows: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join many ``rows`` with at most one row of ``one`` per key, spreading the hot keys over ``salts`` tasks.

    ``hot`` is bounded by :func:`hot_keys`, so both its broadcast and the copies made of the matching
    rows of ``one`` are bounded too. Null keys match nothing.
    """
    flag = F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot")))
    left = rows.join(flag, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.floor(F.rand(7) * salts)).otherwise(F.lit(0)).cast("int")
    )
    right = one.join(flag, key, "left").withColumn(
        "__salt",
        F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.drop("__hot").join(right.drop("__hot"), [key, "__salt"], how).drop("__salt")


def prefix_sum(
    df: DataFrame, by: list[str], order: Column, value: Column, out: str, buckets: int = 4096, tie: str = "row_id"
) -> DataFrame:
    """Exclusive running sum of ``value`` in hash order within ``by``, without a one-task window.

    ``order`` must be a BIGINT spread evenly over its range (a hash). Rows fall into ``buckets`` ranges of
    it; the bucket totals (``buckets`` rows for each combination of ``by``) are summed first and the rows
    are only ordered within their bucket. Ties go by ``tie``. ``by`` values may be null.
    """
    from pyspark.sql import Window as W

    keyed = df.withColumn("__o", order).withColumn("__v", value)
    keyed = keyed.withColumn("__b", F.shiftright(F.col("__o"), 64 - (buckets.bit_length() - 1)).cast("int"))
    totals = keyed.groupBy(*by, "__b").agg(F.sum("__v").alias("__t"))
    w = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
        F.col("__b").alias("__kb"),
        F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__bucket_start"),
    )
    on = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inner = W.partitionBy(*by, "__b").orderBy("__o", tie).rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.join(before, on)
        .withColumn(out, F.col("__bucket_start") + F.coalesce(F.sum("__v").over(inner), F.lit(0)))
        .drop("__o", "__v", "__b", "__bucket_start", "__kb", *[f"__k{i}" for i in range(len(by))])
    )


def hot_list(counts: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_ROWS) -> list:
    """The keys of at least ``hot_rows`` rows, at most ``HOT_SHARE`` of them, the hottest: a bounded list that holds
    every key with a ``HOT_SHARE``-th of the rows. One pass over the counts."""
    return [r[0] for r in counts.where(F.col(n) >= hot_rows).orderBy(F.desc(n), key).limit(HOT_SHARE).select(key).collect()]


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, hot: list | None = None) -> DataFrame:
    """Join many rows with the rows of their key in ``one`` (few a key); keys that are hot in ``rows`` are salted.

    ``hot`` names the hot keys where they are known (see :func:`hot_list`). Else they are looked up, which runs
    ``rows`` once more: cut it before if it is dear.
    """
    if hot is None:
        hot = hot_list(rows.groupBy(key).agg(F.count("*").alias("n")), key, hot_rows=hot_rows)
    if not hot:
        return rows.join(one, key, how)
    listed = rows.sparkSession.createDataFrame([(h,) for h in hot], f"`{key}` {rows.schema[key].dataType.simpleString()}")
    return salted_join(rows, one, key, listed, how)


def bitmap(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """``w, b``: the low ``bits`` bits of the hashes in ``column``, as the set bits of 2**bits / 64 numbers.

    A filter of fixed size, whatever the input: at most 2**(bits - 6) rows, safe to broadcast. It never misses a
    hash; what it lets through by chance must fail a later join.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(slot, 6).cast("int").alias("w")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.select(word, bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def sift(rows: DataFrame, column: str, marks: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash in ``column`` may be in the :func:`bitmap` ``marks``, without a shuffle."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    known = marks.select(F.col("w").alias("__w"), F.col("b").alias("__b"))
    got = rows.withColumn("__w", F.shiftright(slot, 6).cast("int")).join(F.broadcast(known), "__w")  # of fixed size
    return got.where(F.call_function("getbit", F.col("__b"), slot.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("__w", "__b")
