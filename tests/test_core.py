"""General operators against brute force, on small fixtures with nulls, ties, repeats and empty tables."""

import random

from pyspark.sql import functions as F

from gristmill.common import hot_keys, prefix_sum, salted_join, spread_join
from gristmill.operators import rows, tokens


def test_salted_join_equals_plain(spark):
    many = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), "k", hot_rows=100)
    assert [r.k for r in hot.collect()] == [0]
    want = sorted(many.join(one, "k", "left").collect(), key=str)
    assert sorted(salted_join(many, one, "k", hot, "left", 8).select("k", "id", "v").collect(), key=str) == want
    assert sorted(spread_join(many, one, "k", "left", hot_rows=100).select("k", "id", "v").collect(), key=str) == want


def test_prefix_sum_equals_sequential(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i % 7) for i in range(300)], "row_id long, g string, v long")
    got = {r.row_id: r.s for r in prefix_sum(df, ["g"], F.xxhash64("row_id"), F.col("v"), "s", 16).collect()}
    order = {r.row_id: r.h for r in df.select("row_id", F.xxhash64("row_id").alias("h")).collect()}
    for g in (0, 1):
        run = 0
        for i in sorted((i for i in range(300) if bool(i % 3) == bool(g)), key=lambda i: (order[i], i)):
            assert got[i] == run
            run += i % 7


def test_similar_pairs_and_greedy(spark):
    sets = [(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 4, 6]), (4, [1, 2, 3, 4]), (5, [9]), (6, None), (7, [])]
    df = spark.createDataFrame([(i, [str(x) for x in s] if s is not None else None) for i, s in sets], "row_id long, s array<string>")
    got = {(r.a, r.b) for r in rows.similar_pairs(df, "s", 0.8).collect()}
    assert got == {(1, 2), (1, 4), (3, 4)}
    kept = {r.row_id for r in rows.greedy_keep(rows.similar_pairs(df, "s", 0.8), df).collect()}
    assert kept == {1, 3, 5, 6, 7}


def test_copies_of_a_dropped_row_are_dropped(spark):
    sets = [(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4]), (3, [1, 2, 3, 4]), (4, [1, 2, 3, 4]), (5, [8, 9]), (6, [8, 9])]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets], "row_id long, s array<string>")
    kept = {r.row_id for r in rows.greedy_keep(rows.similar_pairs(df, "s", 0.8), df).collect()}
    assert kept == {1, 5}


def test_greedy_settles_long_chains(spark):
    df, chain = spark.range(1, 301).withColumnRenamed("id", "row_id"), [(i, i + 1) for i in range(1, 300)]
    kept = {r.row_id for r in rows.greedy_keep(spark.createDataFrame(chain, "a long, b long"), df).collect()}
    assert kept == set(range(1, 301, 2))


def test_greedy_rounds_equal_the_sequential_rule(spark):
    rng = random.Random(9)
    pairs = {(i, i + 1) for i in range(1, 36)} | {tuple(sorted(rng.sample(range(100, 160), 2))) for _ in range(90)}
    want: set[int] = set()
    for v in range(1, 160):
        if not any((u, v) in pairs for u in want):
            want.add(v)
    df = spark.range(1, 160).withColumnRenamed("id", "row_id")
    kept = {r.row_id for r in rows.greedy_keep(spark.createDataFrame(sorted(pairs), "a long, b long"), df, small_pairs=0).collect()}
    assert kept == want


def test_blocks_and_masks(spark):
    df = spark.createDataFrame([(i, "a", list(range(i * 10, i * 10 + i))) for i in range(8)], "row_id long, s string, ids array<int>")
    flat = [x for i in range(8) for x in range(i * 10, i * 10 + i)]
    got = sorted((r.block, r.ids) for r in tokens.blocks(df, "ids", 5, ["s"]).collect())
    assert got == [(k, flat[5 * k : 5 * k + 5]) for k in range(len(flat) // 5)]
    one = spark.createDataFrame([([1, 5, 2, 2, 2, 7],)], "ids array<int>")
    assert one.select(tokens.loss_mask(F.col("ids"), 1, 2)).first()[0] == [1, 1, 0, 0, 0]
    assert one.select(tokens.fit(F.col("ids"), 3, 0), tokens.fit(F.col("ids"), 8, 0)).first()[:] == ([2, 2, 7], [1, 5, 2, 2, 2, 7, 0, 0])
    assert one.select(tokens.with_ends(F.col("ids"), 1, 9)).first()[0] == [1, 5, 2, 2, 2, 7, 9]


def test_quotas_and_ranks(spark):
    w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, weight long")
    assert {r.source: r.quota for r in rows.largest_remainder(w, 10).collect()} == {"a": 3, "b": 3, "c": 4}
    df = spark.range(100).select(F.col("id").alias("row_id"))
    assert rows.split_exact(df, 0.1, 3).where("split = 'val'").count() == 10
    out = rows.nearest_rank(spark.createDataFrame([(x,) for x in [5, 1, 1, 9, None]], "v long"), "v", [0.0, 0.5, 1.0])
    assert {r.q: r.value for r in out.collect()} == {0.0: 1, 0.5: 5, 1.0: 9}
