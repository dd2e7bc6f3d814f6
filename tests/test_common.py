"""Hot keys, fixed-size filters and checkpoints."""

import pytest
from pyspark.sql import functions as F

from gristmill import common


def test_sift_keeps_all_and_little_more(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    wanted = rows.where("id % 50 = 0")
    marks = common.bitmap(wanted, "h", 12)
    got = {r.id for r in common.sift(rows, "h", marks, 12).collect()}
    assert got >= {r.id for r in wanted.collect()} and len(got) < 600
    assert common.sift(rows, "h", common.bitmap(wanted.limit(0), "h", 12), 12).count() == 0


def test_hot_list_is_bounded(spark, monkeypatch):
    counts = spark.range(100).select(F.col("id").alias("k"), (F.col("id") + 1).alias("n"))
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    assert common.hot_list(counts, "k", hot_rows=50) == [99, 98, 97, 96, 95]
    assert common.hot_list(counts, "k", hot_rows=1000) == []


def test_many_to_many(spark):
    left = spark.range(600).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.range(30).select((F.col("id") % 5).alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, common.spread_join(left, right, "k", hot_rows=100).select("k", "id", "v").collect())) == want
    assert sorted(map(tuple, common.spread_join(left, right, "k", hot=[0]).select("k", "id", "v").collect())) == want


def test_no_machine_local_checkpoints_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context()  # noqa: N815

            class conf:  # noqa: N801
                @staticmethod
                def get(name, default):
                    return default

    with pytest.raises(RuntimeError):
        common.cut(Frame())
