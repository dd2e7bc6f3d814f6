"""Copies, related records and overlaps against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import p3_copies, p4_related, p5_overlap


CONSTRAINTS = ['{"a":1,"b":[1,2],"c":{"x":null}}', '{ "c": {"x": null}, "b":[1, 2],\n"a": 1}', '{"a":"1","b":[1,2],"c":{"x":null}}', '{"a":1.0,"b":[1,2],"c":{"x":null}}', '{"a":1,"b":[2,1],"c":{"x":null}}', "not json", None]


def test_merkle_digest_equals_structure():
    def shape(v):
        if isinstance(v, dict):
            return ("d", frozenset((k, shape(x)) for k, x in v.items()))
        if isinstance(v, list):
            return ("l", tuple(map(shape, v)))
        return (type(v).__name__, v)

    trees = [json.loads(c) for c in CONSTRAINTS[:5]]
    for a in trees:
        for b in trees:
            assert (p3_copies.digest(a) == p3_copies.digest(b)) == (shape(a) == shape(b))
    assert p3_copies.plain("Straße_1!") == p3_copies.plain("STRASSE 1") and p3_copies.plain(None) == ""


def test_copies(spark):
    data = [(1, "Do IT.", "f_x", CONSTRAINTS[0]), (2, "do it", "fX", CONSTRAINTS[1]), (2, "do it", "fX", CONSTRAINTS[1]), (3, "do it", "fx", CONSTRAINTS[2]), (4, None, "fx", CONSTRAINTS[0]), (5, None, "fx", CONSTRAINTS[0]), (6, "", None, None), (7, " ", "", None), (8, "do it", "fx", CONSTRAINTS[3]), (9, "x", None, "not json"), (10, "X", "", "not json"), (11, "x", "", "other")]
    df = spark.createDataFrame(data, "row_id long, p string, e string, c string").withColumn("keep_id", F.lit("clash"))
    got = {(r.keep_id, r.row_id) for r in p3_copies.copies(df, "p", ["p", "e"], ["c"]).collect()}
    assert got == {(1, 1), (1, 2), (6, 6), (6, 7), (9, 9), (9, 10)}
    assert p3_copies.copies(df.limit(0), "p", ["p", "e"], ["c"]).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(p3_copies, "root", lambda texts, trees: b"same")
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "A", None), (4, "B", None), (5, "c", None)], "row_id long, p string, c string")
    # the patched function is pickled by reference, so call the stages with the module as it is here
    got = {(r.keep_id, r.row_id) for r in p3_copies.copies(df, "p", ["p"], ["c"]).collect()}
    assert got >= {(1, 3), (2, 4)} and (1, 2) not in got


def _brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("small", [20, 10**6])
def test_components_equal_union_find(spark, small):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(1, i) for i in range(2, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.v: r.component for r in p4_related.components(df, hops=2, small_edges=small).collect()}
    assert got == _brute_components([e for e in edges if e[0] != e[1]])


def test_related_and_splits(spark):
    data = [(1, "Ann", None, "s", "1", "f"), (2, " ann ", "q", "s", "2", "f"), (3, None, "Q", "t", None, None), (4, "unknown", "n/a", "s", " ", "f"), (5, "Unknown", "-", "s", "", "g"), (6, "b", None, None, "1", "g"), (7, "c", "", "s", "1", "g"), (7, "c", "", "s", "1", "g")]
    df = spark.createDataFrame(data, "row_id long, author string, seed string, source string, source_key string, family string")
    keys = [[F.col("author")], [F.col("seed")], [F.col("source"), F.col("source_key")]]
    got = {(r.group_id, r.row_id) for r in p4_related.related(df, keys).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 7)}
    out = p4_related.split_rows(df, keys, "family", [("train", 0.5), ("test", 0.5)]).collect()
    assert sorted(r.row_id for r in out) == [1, 2, 3, 4, 5, 6, 7]
    assert len({r.split_name for r in out if r.group_id == 1}) == 1


def test_split_shares(spark):
    df = spark.range(20000).select(F.col("id").alias("row_id"), F.floor(F.col("id") / 3).alias("group_id"), F.concat(F.lit("f"), F.col("id") % 4).alias("stratum"))
    df = df.unionByName(spark.range(20000, 26000).select(F.col("id").alias("row_id"), F.lit(10**6).alias("group_id"), F.lit("f1").alias("stratum")))
    out = p4_related.group_splits(df, [("train", 0.85), ("val", 0.075), ("test", 0.075)])
    n = {r.split_name: r["count"] for r in out.groupBy("split_name").count().collect()}
    assert abs(n["train"] / 26000 - 0.85) < 0.002 and abs(n["val"] / 26000 - 0.075) < 0.002
    assert out.groupBy("group_id").agg(F.countDistinct("split_name").alias("k")).where("k > 1").count() == 0


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_banded_equals_plain_edit_distance():
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(len(b)) : rng.randrange(len(b)) + 1] = [rng.randrange(5) for _ in range(rng.randrange(3))]
            b = b or [1]
        pairs.append((np.array(a), np.array(b)))
    got = p5_overlap.banded(pairs, np.array([6] * len(pairs)))
    for (a, b), d in zip(pairs, got):
        true = _edit(list(a), list(b))
        assert d == true if true <= 6 else d > 6


def test_segments_are_disjoint_and_enough():
    for a in [1, 2, 5, 6, 7, 50, 333, 601, 1800, 5000]:
        k, q = p5_overlap.plan(a)
        starts = p5_overlap.choose(np.random.default_rng(a).random(a - q + 1), a, k, q)
        assert len(starts) == k + 1 and starts[-1] + q <= a
        assert all(y - x >= q for x, y in zip(starts, starts[1:]))
        assert q in p5_overlap.lengths_for(a)


def test_cross_split(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(40)]
    data, i = [], 0

    def add(words, split):
        nonlocal i
        i += 1
        half = len(words) // 2
        data.append((i, [{"role": "system", "content": f"s{i}"}, {"role": "user", "content": " ".join(words[:half])}, None, {"role": "assistant", "content": " ".join(words[half:])}], split))

    for w in base:
        add(w, "train")
        noisy = list(w)
        for _ in range(int(rng.choice([0, 0.05, 0.1, 0.4]) * len(w))):
            at = rng.randrange(len(noisy))
            noisy[at : at + 1] = rng.choice([[], ["new"], [noisy[at], "new"]])
            noisy = noisy or ["x"]
        add(noisy, rng.choice(["val", "test"]))
    add(base[0], "train")
    data += [(900, None, "val"), (901, [], "train"), (902, [{"role": "user", "content": None}], "test"), (1, data[0][1], "train")]
    df = spark.createDataFrame(data, "row_id long, messages array<struct<role:string,content:string>>, split string")
    pairs, evals, trains = p5_overlap.cross_split(df, F.col("messages"), F.col("split"))
    got = {(r.id_a, r.id_b) for r in p5_overlap.row_pairs(pairs, evals, trains).collect()}
    words = {r[0]: [w for m in r[1] if m and m["role"] != "system" for w in (m["content"] or "").split()] for r in data if r[1]}
    split = {r[0]: r[2] for r in data}
    sure, maybe = set(), set()
    for e in [x for x in words if split[x] != "train" and words[x]]:
        for t in [x for x in words if split[x] == "train" and words[x]]:
            s = 1 - _edit(words[e], words[t]) / max(len(words[e]), len(words[t]))
            (sure if s > 0.85 else maybe if s >= 0.8 else set()).add((min(e, t), max(e, t)))
    assert sure <= got <= sure | maybe and len(sure) > 15
    report = p5_overlap.overlap_report(df, pairs, evals, trains, F.col("split"), F.lit("d")).agg(F.sum("pairs")).first()[0]
    assert report == len(got)


def test_strata_by_name(spark):
    """150 families and the null family stand for themselves; every one comes near the targets."""
    fam = F.when(F.col("id") % 151 < 150, F.concat(F.lit("f"), (F.col("id") % 151).cast("string")))
    df = spark.range(30200).select(F.col("id").alias("row_id"), F.floor(F.col("id") / 302).cast("long").alias("x"), F.col("id").alias("group_id"), fam.alias("stratum"))
    for share in (1000, 2):  # fitted together, or each cut by itself
        p4_related.BIG_STRATA, old = share, p4_related.BIG_STRATA
        out = p4_related.group_splits(df, [("train", 0.8), ("test", 0.2)])
        p4_related.BIG_STRATA = old
        n = {(r.stratum, r.split_name): r["count"] for r in out.groupBy("stratum", "split_name").count().collect()}
        names = {k[0] for k in n}
        assert len(names) == 151 and None in names and "f7" in names
        assert all(abs(n[f, "train"] / (n[f, "train"] + n[f, "test"]) - 0.8) < 0.02 for f in names)
        assert out.count() == 30200


def test_forms_of_single_rows_stay(spark, monkeypatch):
    """With a filter of few bits the result is the same."""
    monkeypatch.setattr(p3_copies, "FILTER_BITS", 7)
    df = spark.createDataFrame([(i, f"text {i % 60}", None) for i in range(100)], "row_id long, p string, c string")
    got = {(r.keep_id, r.row_id) for r in p3_copies.copies(df, "p", ["p"], ["c"]).collect()}
    assert got == {(i % 60, i) for i in range(100) if i % 60 < 40}


def test_words_and_hot_grams(spark, monkeypatch):
    assert p5_overlap.words_of("Don't 不要 कहा था") == ["don", "t", "不", "要", "कहा", "था"]
    monkeypatch.setattr(p5_overlap, "FILTER_BITS", 8)
    same = "the quick brown fox jumps over the lazy dog and runs away from it"
    data = [(i, [{"role": "user", "content": f"{same} w{i % 25}"}], "train" if i % 3 else "val") for i in range(90)]
    df = spark.createDataFrame(data, "row_id long, messages array<struct<role:string,content:string>>, split string")
    pairs, evals, trains = p5_overlap.cross_split(df, F.col("messages"), F.col("split"))
    assert p5_overlap.row_pairs(pairs, evals, trains).count() == 30 * 60


def test_pairs_up_to_the_most_edits_are_found():
    """Edits anywhere, as many as may be: what is asked for beside a segment loses no pair."""
    rng = random.Random(5)
    lefts, rights = [], []
    for i in range(400):
        a = [rng.randrange(40) for _ in range(rng.choice([1, 3, 7, 13, 30, 60, 170, 700]))]
        b = list(a)
        for _ in range(int(0.15 * len(a))):
            at = rng.randrange(len(b)) if i % 3 else rng.choice([0, len(b) - 1])
            b[at : at + 1] = rng.choice([[], [41], [b[at], 41], [41, b[at]]])
        if b and _edit(a, b) < 0.15 * max(len(a), len(b)):
            lefts.append(np.array(a, np.int32))
            rights.append(np.array(b, np.int32))
    ids, none = np.arange(len(lefts)), np.zeros(1 << 8, np.uint8)
    left, right = (p5_overlap.Sequences(ids, np.zeros((len(s), 2), np.int64), np.array([len(x) for x in s]), np.concatenate(s)) for s in (lefts, rights))
    left.starts = p5_overlap._segment_starts(left)
    got = set(p5_overlap.Block([left.pack()], none).match(right, np.ones(len(ids), bool)))
    assert len(ids) > 250 and {(i, i) for i in range(len(ids))} <= got


def test_overlaps_write_less_than_the_texts(spark, monkeypatch, tmp_path):
    """Neither grams nor candidates are kept on disk; several blocks of evaluation rows give the pairs of one."""
    rng = random.Random(8)
    phrases = [" ".join(rng.choice(["red", "old", "fast", "thin"]) + str(rng.randrange(30)) for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choice(phrases) for _ in range(30)) for _ in range(600)]
    data = [(i, [{"role": "user", "content": t}], "val" if i % 4 == 0 else "train") for i, t in enumerate(texts)]
    data += [(1000 + i, [{"role": "user", "content": f"so {texts[i]}"}], "train") for i in range(0, 80, 4)]
    df = spark.createDataFrame(data, "row_id long, messages array<struct<role:string,content:string>>, split string")
    monkeypatch.setattr(p5_overlap, "BLOCK", 4000)
    sc, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        pairs, evals, trains = p5_overlap.cross_split(df, F.col("messages"), F.col("split"))
        got = {(r.id_a, r.id_b) for r in p5_overlap.row_pairs(pairs, evals, trains).collect()}
        written = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    finally:
        if before:
            sc.setCheckpointDir(before)
    assert got == {(i, 1000 + i) for i in range(0, 80, 4)}
    assert written < sum(len(t) for t in texts)
