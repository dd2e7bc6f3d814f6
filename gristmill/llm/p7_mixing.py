"""Mixing sources to target weights by the cube method.

The mixture's size is the largest at which every source with documents can give its share without using
a document more often than allowed. A source then needs r = need / supply uses of each document: floor(r)
for all of them and one more for a balanced sample of inclusion probability r - floor(r).

Flight: three probabilities at a time move along the null space of the token and document constraints until
one of them is 0 or 1. Partitions fly on their own, the longest documents first; the ``STAY`` to ``MOST``
undecided documents of each partition and source are flown again together, level by level, until one task a
source holds all that are left (at most ``FAN_IN * MOST``, whatever the input). There the flight goes on.
Landing: where the other undecided documents could soon no longer make up for the longest one, the document
constraint is dropped for it (it is drawn by its probability and the others make up its tokens), and the last
``LANDING`` documents are decided by the best of all their combinations. The same holds at every size;
column ``stage`` of :func:`mix` tells where a document was decided.

Defined results: sources without documents, and targets with no positive weight, get nothing and the other
shares are relative to each other; sources without a target (null too) are not used; documents without
tokens are not used; max_repeats null or below 1 excludes a source.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut

LANDING = 24
STAY, MOST = 64, 512
FAN_IN = 32
_EPS = 1e-9


def _open(u: list) -> bool:
    return _EPS < u[2] < 1 - _EPS


def _step(active: list[list], rng: random.Random) -> list[list]:
    """One move of the longest, the next and the shortest unit; the ones it decides leave ``active``."""
    at = (0, 1, len(active) - 1)
    trio = [active[i] for i in at]
    t = [u[1] for u in trio]
    move = [t[2] - t[1], t[0] - t[2], t[1] - t[0]]
    if not any(move):
        move = [1, -1, 0]
    up = min(((1 - u[2]) / m if m > 0 else u[2] / -m) for u, m in zip(trio, move) if m)
    down = min((u[2] / m if m > 0 else (1 - u[2]) / -m) for u, m in zip(trio, move) if m)
    step = up if rng.random() * (up + down) < down else -down
    for u, m in zip(trio, move):
        u[2] = min(1.0, max(0.0, u[2] + step * m))
    gone = []
    for i, u in zip(reversed(at), reversed(trio)):
        if not _open(u):
            gone.append(u)
            del active[i]
    return gone


class _Air:
    """Undecided units of a source, the longest first, with their tokens expected in and out of the mixture.

    ``spare`` units don't move but count."""

    def __init__(self, units: list[list], spare: list[list] = []):  # noqa: B006 - never changed
        self.units = units
        self.inside = sum(u[1] * u[2] for u in (*units, *spare))
        self.outside = sum(u[1] * (1 - u[2]) for u in (*units, *spare))

    def add(self, u: list) -> None:
        self.units.append(u)
        self.inside += u[1] * u[2]
        self.outside += u[1] * (1 - u[2])

    def needs(self) -> tuple[float, float, float, float]:
        """Tokens the others give and must give if the longest comes in; their room and its need if it stays out."""
        t, p = self.units[0][1:3]
        return self.inside - p * t, (1 - p) * t, self.outside - (1 - p) * t, p * t

    def balanced(self) -> bool:
        """Whether the others, also without the next longest, can make up for the longest, twice over."""
        give, more, room, less = self.needs()
        t, p = self.units[1][1:3]
        return give - p * t > 2 * more and room - (1 - p) * t > 2 * less

    def step(self, rng: random.Random) -> list[list]:
        gone = _step(self.units, rng)
        for u in gone:
            if u[2] > 0.5:
                self.inside -= u[1]
            else:
                self.outside -= u[1]
        return gone


def fly(units: list[list], stay: int, rng: random.Random, most: int = 0) -> list[list]:
    """Move ``[id, tokens, probability]`` units, the longest first, until at most ``stay`` are undecided (up to
    ``most`` where the longest of them could not be balanced by the others); all are given back."""
    done, air = [], _Air([])
    for u in units:
        if not _open(u):
            done.append(u)
            continue
        air.add(u)
        n = len(air.units)
        if n > max(stay, 2) and (n > most or air.balanced()):
            done += air.step(rng)
    return done + air.units


def land(units: list[list]) -> None:
    """Decide the last units so that their tokens come nearest to the expected total, then their number.

    All combinations count: the sums of one half are searched for the best partner of each sum of the other.
    """
    if not units:
        return
    t = np.array([u[1] for u in units], float)
    p = np.array([u[2] for u in units])
    h = len(units) // 2
    left = (np.arange(1 << h)[:, None] >> np.arange(h)) & 1
    right = (np.arange(1 << (len(units) - h))[:, None] >> np.arange(len(units) - h)) & 1
    ls, rs = left @ t[:h], right @ t[h:]
    order = np.argsort(rs, kind="stable")
    near = np.searchsorted(rs[order], p @ t - ls)
    best = None
    for k in (near - 1, near):
        pick = order[np.clip(k, 0, len(order) - 1)]
        error = np.abs(ls + rs[pick] - p @ t)
        number = np.abs(left.sum(1) + right[pick].sum(1) - p.sum())
        i = int(np.lexsort((number, np.round(error)))[0])
        got = (round(float(error[i])), float(number[i]), [*left[i], *right[pick[i]]])
        best = got if best is None or got[:2] < best[:2] else best
    for u, k in zip(units, best[2]):
        u[2] = float(k)


def _spare(units: list[list]) -> list[list]:
    """Up to ``LANDING - 4`` units of different sizes among the shorter half, so that combinations differ finely."""
    sizes = {u[1]: u for u in units[len(units) // 2 :]}
    each = [sizes[t] for t in sorted(sizes)]
    n = LANDING - 4
    return each if len(each) <= n else [each[i * len(each) // n] for i in range(n)]


def settle(units: list[list], rng: random.Random) -> list[list]:
    """Decide all units of a source; the ones that were landed (drawn or combined) are given back."""
    ordered = sorted((u for u in units if _open(u)), key=lambda u: (-u[1], u[0]))
    spare = _spare(ordered)
    held = {u[0] for u in spare}
    air = _Air([u for u in ordered if u[0] not in held], spare)
    landed: list[list] = []
    while len(air.units) + len(spare) > LANDING and len(air.units) > 2:
        if air.balanced():
            air.step(rng)
            continue
        long, *rest = air.units
        give, more, room, less = air.needs()
        take = rng.random() < long[2]
        take = take if (give >= more if take else room >= less) else not take
        keep = max(0.0, give - more) / give if take and give else max(0.0, room - less) / room if room else 0.0
        for u in (*rest, *spare):
            u[2] = u[2] * keep if take else 1 - (1 - u[2]) * keep
        long[2] = float(take)
        landed += [long, *(u for u in (*rest, *spare) if not _open(u))]
        spare = [u for u in spare if _open(u)]
        air = _Air([u for u in rest if _open(u)], spare)
    land(air.units + spare)
    return landed + air.units + spare


_FLOWN = "doc_id long, source string, n_tokens long, chance double, stage string"


def _flight(seed: int, level: int, final: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rngs: dict[str, random.Random] = {}
        held: dict[str, list[list]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "source", "n_tokens", "chance", "stage"])

        for b in batches:
            new: dict[str, list[list]] = {}
            for doc, source, tokens, chance in zip(*(b.column(i).to_pylist() for i in range(4))):
                new.setdefault(source, []).append([doc, tokens, chance])
            rows = []
            for source, units in new.items():
                if final:
                    held.setdefault(source, []).extend(units)
                    continue
                rng = rngs.setdefault(source, random.Random(f"{seed}/{level}/{part}/{source}"))
                flown = fly(held.get(source, []) + units, STAY, rng, MOST)
                held[source] = [u for u in flown if _open(u)]
                rows += [(u[0], source, u[1], float(round(u[2])), f"flight {level}") for u in flown if not _open(u)]
            yield out(rows)
        for source, units in held.items():
            landed = {u[0] for u in settle(units, random.Random(f"{seed}/{source}"))} if final else set()
            yield out([(u[0], source, u[1], float(round(u[2])) if final else u[2], "landing" if u[0] in landed else f"flight {level}") for u in units])

    return run


def quotas(supply: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, float]]:
    """source -> (share, tokens needed) of the largest mixture that all sources can serve."""
    usable = {s: (w, m) for s, w, m in targets if s is not None and w and w > 0 and m and m >= 1 and supply.get(s, (0, 0))[0] > 0}
    total = sum(w for w, _ in usable.values())
    if not usable:
        return {}
    size = min(supply[s][0] * m * total / w for s, (w, m) in usable.items())
    return {s: (w / total, size * w / total) for s, (w, _) in usable.items()}


def mix(documents: DataFrame, targets: list[tuple[str, float, int]], seed: int = 17) -> tuple[DataFrame, dict[str, tuple[float, float]], dict[str, tuple[int, int]]]:
    """``doc_id, source, n_tokens, times, stage`` of the mixture from ``doc_id, source, n_tokens``; quotas; supply."""
    spark = documents.sparkSession
    names = spark.createDataFrame([(s,) for s in {t[0] for t in targets if t[0] is not None}], "source string")
    docs = documents.where(F.col("n_tokens") > 0).join(F.broadcast(names), "source", "left_semi")  # one row a target
    docs = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_tokens").cast("long").alias("n_tokens")))
    supply = {r[0]: (r[1], r[2]) for r in docs.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    need = quotas(supply, targets)
    most = {s: m for s, _, m in targets}
    rates = [(s, *_rate(q / supply[s][0], most[s])) for s, (_, q) in need.items()]
    known = F.broadcast(spark.createDataFrame(rates, "source string, base int, chance double"))  # one row a target
    placed = docs.join(known, "source")
    sure = placed.where(F.col("chance") == 0).select("doc_id", "source", "n_tokens", F.col("base").alias("times"), F.lit("all alike").alias("stage"))
    if not any(c > 0 for _, _, c in rates):
        return sure.where(F.col("times") > 0), need, supply
    todo = placed.where(F.col("chance") > 0).select("doc_id", "source", "n_tokens", "chance")
    flown_by, level, decided = 0, 0, None
    while True:
        final = 0 < flown_by <= FAN_IN
        if final:
            ready = todo.repartition(min(FAN_IN, len(rates)), "source")
        else:
            if flown_by:
                flown_by = -(-flown_by // FAN_IN)
                todo = todo.repartition(flown_by, F.xxhash64("doc_id"))
            else:
                flown_by = max(1, docs.rdd.getNumPartitions())
            # the longest documents first, so that those left over are the shortest and can make up for the last long ones
            ready = todo.sortWithinPartitions(F.desc("n_tokens"), "doc_id")
        flown = cut(ready.mapInArrow(_flight(seed, level, final), _FLOWN))
        settled = flown.where(F.col("chance").isin(0.0, 1.0))
        decided = settled if decided is None else decided.unionByName(settled)
        if final:
            break
        todo, level = flown.where(~F.col("chance").isin(0.0, 1.0)).drop("stage"), level + 1
    drawn = decided.join(known.drop("chance"), "source").select("doc_id", "source", "n_tokens", (F.col("base") + F.col("chance")).cast("int").alias("times"), "stage")
    return sure.unionByName(drawn).where(F.col("times") > 0), need, supply


def _rate(r: float, most: int) -> tuple[int, float]:
    base = int(r + 1e-9)
    chance = max(0.0, r - base)
    if base >= most or chance < 1e-9:
        return min(base, most), 0.0
    return base, chance


def shares(mixture: DataFrame, need: dict, supply: dict, targets: list[tuple[str, float, int]]) -> DataFrame:
    """Target and actual shares of every target's source."""
    spark = mixture.sparkSession
    used = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.count("*").alias("documents"), F.sum("times").alias("uses"), F.max("times").alias("most_repeats")
    )
    rows = [(s, w, m, supply.get(s, (0, 0))[0], need.get(s, (0.0, 0.0))[0]) for s, w, m in targets]
    goal = spark.createDataFrame(rows, "source string, target_weight double, max_repeats int, supply_tokens long, target_share double")
    total = F.broadcast(used.agg(F.sum("used_tokens").alias("__all")))
    joined = goal.join(used, "source", "left").crossJoin(total)
    for c in ("used_tokens", "documents", "uses", "most_repeats"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    actual = F.col("used_tokens") / F.col("__all")
    return joined.withColumn("actual_share", F.round(actual, 6)).withColumn("error", F.round(actual - F.col("target_share"), 6)).drop("__all")
