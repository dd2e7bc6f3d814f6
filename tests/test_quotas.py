"""Quotas, epochs, group splits and lookups against plain Python."""

import random

from pyspark.sql import functions as F

from gristmill.operators import quotas


def test_epochs(spark):
    rows = [(i, "a" if i < 5 else "b", 10) for i in range(10)] + [(20, "c", 0), (21, None, 3)]
    df = spark.createDataFrame(rows, "row_id long, source string, n long")
    quota = spark.createDataFrame([("a", 125), ("b", 25), ("c", 10)], "source string, quota long")
    got = {r.row_id: r.times for r in quotas.epochs(df, "source", "n", quota).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1}
    assert quotas.epochs(df.limit(0), "source", "n", quota).count() == 0


def test_top_of_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, g string, v long")
    want = {(i, k) for g in "ab" for k, (i, _, _) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))[:7], 1)}
    assert {(r.row_id, r.rank) for r in quotas.top_of_groups(df, ["g"], [F.col("v")], 7, parts=4).collect()} == want
    assert quotas.seeded_cap(df, ["g"], 3, 1).count() == 6


def test_family_quotas():
    assert quotas.family_quotas({"a": 10, "b": 10, "c": 10}, 100) == {"a": 10, "b": 10, "c": 10}
    assert quotas.family_quotas({}, 5) == {}
    for total in (1, 7, 20, 29):
        got = quotas.family_quotas({"a": 3, "b": 17, "c": 10}, total)
        assert sum(got.values()) == total and all(got[f] <= n for f, n in (("a", 3), ("b", 17), ("c", 10)))


def test_groups_to_val(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}") for i in range(400)], "row_id long, gid string")
    got = {r.split: r["sum(n)"] for r in quotas.groups_to_val(df, "gid", 0.1, 3).groupBy("split").sum("n").collect()}
    assert got == {"val": 40, "train": 360}
    one = quotas.groups_to_val(df.where("gid = 'g1'"), "gid", 0.1, 3).collect()
    assert [(r.gid, r.split) for r in one] == [("g1", "val")]
    split = quotas.with_group_split(df, quotas.groups_to_val(df, "gid", 0.1, 3), "gid")
    assert split.groupBy("gid").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0 and split.count() == 400


def test_quotas_with_topup(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(20)], "row_id long, source string")
    got = {r.row_id: r.first_choice for r in quotas.quotas_with_topup(df, "source", {"a": 3, "gone": 5}, 8).collect()}
    assert got == {1: True, 3: True, 5: True, 0: False, 2: False, 4: False, 6: False, 7: False}


def test_locate(spark):
    shards = spark.createDataFrame([(0, 3), (1, 70), (2, 1)], "shard long, blocks long")
    runs = quotas.sized_runs(shards, [])
    blocks = spark.range(80).withColumnRenamed("id", "block")
    got = {r.block: (r.shard, r.offset) for r in quotas.locate(blocks, runs, 16).collect()}
    want = [(0, k) for k in range(3)] + [(1, k) for k in range(70)] + [(2, 0)]
    assert got == dict(enumerate(want))
