"""Splits that keep related records together: frontier breadth-first components and a split by hash order.

Rows that share a key are one component. Every key's smallest row is the centre of a star, which turns the
row-key graph into a row-row graph with at most one edge for each row and key. Components of that graph are
found level by level: seeds chosen by hash grow breadth-first and at the same time, each vertex takes the
smallest label that reaches it first, seeds that meet are an edge of the next, much smaller graph. When that
graph has at most ``SMALL_EDGES`` edges, one task merges it with union-find; else the next level treats it
the same way. No adjacency list is ever built in one place; hubs are joined with salt.

Defined results: null, blank and placeholder keys join nothing; a row without keys is its own component;
repeated rows and repeated keys change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut, hot_list, one_delivery, prefix_sum, spread_join

#: Texts that stand for a missing key.
PLACEHOLDERS = ("", "unknown", "n/a", "none", "anonymous", "-")
SEED_RATE = 8
HOPS = 4
SMALL_EDGES = 500_000
#: Components of at least 1/BIG_SHARE of all rows (so at most BIG_SHARE) are placed one by one.
BIG_SHARE = 1_000
#: Strata of at least 1/BIG_STRATA of all rows (so at most BIG_STRATA) are fitted together.
BIG_STRATA = 1_000


def clean_key(c: Column) -> Column:
    """A key without outer white space and case; null where it is a placeholder."""
    k = F.lower(F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""))
    return F.when(~k.isin(*PLACEHOLDERS), k)


def links(df: DataFrame, keys: list[list[Column]]) -> DataFrame:
    """``row_id, key`` for each key of a row; a key of several columns needs all of them."""
    parts = []
    for i, cols in enumerate(keys):
        cleaned = [clean_key(c) for c in cols]
        whole = cleaned[0].isNotNull()
        for c in cleaned[1:]:
            whole = whole & c.isNotNull()
        parts.append(F.when(whole, F.concat_ws("\x1f", F.lit(str(i)), *cleaned)))
    return (
        df.where(F.col("row_id").isNotNull())
        .select("row_id", F.explode(F.array_compact(F.array(*parts))).alias("key"))
    )


def star_edges(linked: DataFrame) -> DataFrame:
    """``u, v``: each row and the smallest row of each of its keys."""
    centre = cut(linked.groupBy("key").agg(F.min("row_id").alias("u"), F.count("*").alias("n")))
    return (
        spread_join(linked, centre.drop("n"), "key", hot=hot_list(centre, "key"))
        .where(F.col("row_id") != F.col("u"))
        .select("u", F.col("row_id").alias("v"))
        .distinct()
    )


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    out = [(x, find(x)) for x in list(parent)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["v", "label"]
    )


def _grow(adjacent: DataFrame, level: int, seed_rate: int, hops: int, hot: list) -> DataFrame:
    """``v, label`` for all vertices after growing seeds for some hops.

    What no seed reached takes the neighbour (or itself) of least hash, so every component shrinks.
    """
    order = F.struct(F.xxhash64("u", F.lit(~level)).alias("h"), F.col("u"))
    vertices = adjacent.groupBy("v").agg(F.min(order).alias("__near"))
    own = F.struct(F.xxhash64("v", F.lit(~level)).alias("h"), F.col("v").alias("u"))
    is_seed = F.pmod(F.xxhash64("v", F.lit(level)), F.lit(seed_rate)) == 0
    labels = cut(vertices.where(is_seed).select("v", F.col("v").alias("label")))
    frontier = labels
    for _ in range(hops):
        sent = spread_join(adjacent, frontier.withColumnRenamed("v", "u"), "u", hot=hot).groupBy("v").agg(F.min("label").alias("label"))
        frontier = cut(sent.join(labels.select("v"), "v", "left_anti"))
        if frontier.isEmpty():
            break
        labels = labels.unionByName(frontier)
    return cut(vertices.join(labels, "v", "left").select("v", F.coalesce(F.col("label"), F.least(F.col("__near"), own)["u"]).alias("label")))


def components(edges: DataFrame, seed_rate: int = SEED_RATE, hops: int = HOPS, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``v, component`` for every vertex of the undirected ``u, v`` edges; component is its smallest vertex."""
    level, maps = 0, []
    pairs = edges.where(F.col("u") != F.col("v")).select("u", "v")
    while True:
        adjacent = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        hot = hot_list(adjacent.groupBy("u").agg(F.count("*").alias("n")), "u")  # of u and of v: both directions are here
        labels = _grow(adjacent, level, seed_rate, hops, hot)
        maps.append(labels)
        of_u = labels.select(F.col("v").alias("u"), F.col("label").alias("lu"))
        of_v = labels.select("v", F.col("label").alias("lv"))
        met = spread_join(spread_join(adjacent, of_u, "u", hot=hot), of_v, "v", hot=hot).where(F.col("lu") < F.col("lv"))
        pairs = cut(met.select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
        n = pairs.count()
        if n == 0:
            break
        if n <= small_edges:
            maps.append(pairs.coalesce(1).mapInArrow(_union_find, "v long, label long"))
            break
        level += 1
    out = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("v").alias("label"), F.col("label").alias("__next"))
        out = cut(spread_join(out, step, "label", "left").select("v", F.coalesce("__next", "label").alias("label")))
    smallest = out.groupBy("label").agg(F.min("v").alias("component"))
    return spread_join(out, smallest, "label").select("v", "component")


def related(df: DataFrame, keys: list[list[Column]]) -> DataFrame:
    """``group_id, row_id`` of all rows that share a group with another row, the smallest row included."""
    found = components(star_edges(cut(links(df, keys))))
    return found.select(F.col("component").alias("group_id"), F.col("v").alias("row_id"))


#: Stands for all strata that are not fitted.
_REST = "\0rest"


def group_splits(rows: DataFrame, targets: list[tuple[str, float]], seed: int = 13) -> DataFrame:
    """Add ``split_name`` to ``row_id, group_id, stratum`` rows; a group never spans splits.

    Groups of at least 1/``BIG_SHARE`` of the rows are placed one by one, the largest first, where their
    strata fall shortest of their targets. All other groups are ordered by hash within their main stratum
    and cut at the shares that are left, so all rows together and every stratum come as near to the targets
    as whole groups allow. Strata of at least 1/``BIG_STRATA`` of the rows are fitted together, because a
    group's rows may lie in several; the groups of each smaller stratum are cut at the targets themselves.
    A null stratum is a stratum of its own and comes out as null.
    """
    spark = rows.sparkSession
    names = [n for n, _ in targets]
    if not names:
        raise ValueError("no splits given")
    whole = sum(max(s, 0.0) for _, s in targets) or 1.0
    share = {n: max(s, 0.0) / whole for n, s in targets}
    given = rows
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("")))
    sizes = cut(rows.groupBy("group_id", "stratum").agg(F.count("*").alias("n")))
    groups = cut(
        sizes.groupBy("group_id").agg(
            F.sum("n").alias("size"), F.max(F.struct("n", "stratum"))["stratum"].alias("main")
        )
    )
    total = groups.agg(F.sum("size")).first()[0] or 0
    of_stratum = sizes.groupBy("stratum").agg(F.sum("n").alias("n"))
    per = {r[0]: r[1] for r in of_stratum.where(F.col("n") * BIG_STRATA >= total).collect()}  # at most BIG_STRATA
    per[_REST] = total - sum(per.values())
    big = groups.where((F.col("size") * BIG_SHARE >= total) & (F.col("size") > 50))  # at most BIG_SHARE groups
    parts: dict[int, dict[str, int]] = {}
    for r in big.join(sizes, "group_id").select("group_id", "stratum", "n").collect():
        own, f = parts.setdefault(r[0], {}), r[1] if r[1] in per else _REST
        own[f] = own.get(f, 0) + r[2]
    need = {(f, n): per[f] * share[n] for f in per for n in names}
    placed = {}
    for g in sorted(parts, key=lambda x: (-sum(parts[x].values()), x)):
        size = sum(parts[g].values())

        def over(n: str, g: int = g) -> float:
            return sum(max(0.0, k - need[f, n]) for f, k in parts[g].items())

        left = {n: sum(need[f, n] for f in per) for n in names}
        best = min(names, key=lambda n: (max(0.0, size - left[n]), over(n), -left[n], n))
        placed[g] = best
        for f, k in parts[g].items():
            need[f, best] -= k
    fixed = spark.createDataFrame(list(placed.items()), "group_id long, split_name string")
    small = groups.join(F.broadcast(fixed.select("group_id")), "group_id", "left_anti")
    fitted = F.broadcast(spark.createDataFrame([(f,) for f in per], "stratum string"))  # at most BIG_STRATA rows
    own = sizes.join(small.select("group_id", "main"), "group_id")
    own = own.join(fitted.withColumnRenamed("stratum", "main"), "main", "left_semi").join(fitted, "stratum", "left_semi")
    mixed = own.groupBy("main", "stratum").agg(F.sum("n")).collect()  # at most BIG_STRATA squared, those that occur
    fractions = _fractions(mixed, {k: max(0.0, v) for k, v in need.items()}, names, share)
    cuts = []
    for f, row in fractions.items():
        at = 0.0
        for n, r in zip(names, row):
            if r > 0:
                cuts.append((f, n, at, at + r))
                at += r
    # the last cut of each stratum is open above
    last = {f: max(c[3] for c in cuts if c[0] == f) for f in fractions}
    cuts = [(f, n, a, 2.0 if b >= last[f] else b) for f, n, a, b in cuts]
    bounds = F.broadcast(spark.createDataFrame(cuts, "main string, split_name string, __from double, __to double"))
    usual, at = [], 0.0
    for n in names:
        usual.append((n, at, at + share[n]))
        at += share[n]
    last_used = max((u for u in usual if u[2] > u[1]), key=lambda u: u[2], default=usual[0])[0]
    usual = F.broadcast(spark.createDataFrame([(n, a, 2.0 if n == last_used else b) for n, a, b in usual], "__name string, __ufrom double, __uto double"))
    ordered = prefix_sum(small, ["main"], F.xxhash64("group_id", F.lit(seed)), F.col("size"), "__before", tie="group_id")
    of_main = ordered.groupBy("main").agg(F.sum("size").alias("__all"))
    at = (F.col("__before") + F.col("size") / 2) / F.col("__all")
    placed_at = cut(ordered.join(of_main, "main").withColumn("__at", at).select("group_id", "main", "__at"))
    known = F.broadcast(spark.createDataFrame([(f,) for f in fractions], "main string"))  # at most BIG_STRATA rows
    inside = (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))
    by_fit = placed_at.join(bounds, "main").where(inside).select("group_id", "split_name")  # (one bound a split and stratum)
    plain = placed_at.join(known, "main", "left_anti").crossJoin(usual)  # one row a split
    plain = plain.where((F.col("__at") >= F.col("__ufrom")) & (F.col("__at") < F.col("__uto"))).select("group_id", F.col("__name").alias("split_name"))
    cut_small = by_fit.unionByName(plain)
    return spread_join(given, cut(cut_small.unionByName(fixed)), "group_id").select("row_id", "group_id", "stratum", "split_name")


def _fractions(mixed: list, need: dict, names: list[str], share: dict) -> dict[str, list[float]]:
    """The part of each main stratum that goes to each split so that strata come to their needs.

    ``mixed`` holds the rows of every stratum in the groups of every main stratum (at most BIG_STRATA
    squared numbers); proportions are fitted by iterative scaling.
    """
    mains, strata = sorted({r[0] for r in mixed}), sorted({r[1] for r in mixed})
    if not mains:
        return {}
    m = np.zeros((len(mains), len(strata)))
    for a, f, n in mixed:
        m[mains.index(a), strata.index(f)] = n
    want = np.array([[need[f, n] for n in names] for f in strata])
    want = want * (m.sum(0) / np.maximum(want.sum(1), 1e-9))[:, None]
    x = np.tile([share[n] for n in names], (len(mains), 1)) + 1e-9
    weight = m / m.sum(1, keepdims=True)
    for _ in range(300):
        ratio = (want + 1e-9) / (m.T @ x + 1e-9)
        x = x * (weight @ ratio)
        x /= x.sum(1, keepdims=True)
        # all rows together come first
        x = x * ((want.sum(0) + 1e-9) / (m.sum(1) @ x + 1e-9))
        x /= x.sum(1, keepdims=True)
    return {a: [float(v) if v > 1e-7 else 0.0 for v in x[k]] for k, a in enumerate(mains)}


def split_rows(df: DataFrame, keys: list[list[Column]], stratum: str, targets: list[tuple[str, float]]) -> DataFrame:
    """Group related rows and assign every row of ``df`` a split."""
    rows = one_delivery(df.select("row_id", F.col(stratum).alias("stratum")).where(F.col("row_id").isNotNull()))
    grouped = rows.join(related(df, keys), "row_id", "left").withColumn("group_id", F.coalesce("group_id", "row_id"))
    return group_splits(cut(grouped), targets)


def split_report(assigned: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """Rows and share of each split within every stratum and over all rows (stratum null)."""
    counted = assigned.groupBy("stratum", "split_name").agg(F.count("*").alias("rows"))
    both = counted.unionByName(counted.groupBy("split_name").agg(F.sum("rows").alias("rows")).withColumn("stratum", F.lit(None).cast("string")))
    goal = F.broadcast(assigned.sparkSession.createDataFrame([(n, float(s)) for n, s in targets], "split_name string, target_share double"))
    share = F.round(F.col("rows") / F.sum("rows").over(W.partitionBy("stratum")), 6)
    return both.withColumn("share", share).join(goal, "split_name", "left")
