"""Filling fixed-capacity containers: bounded-space online best-fit packing, leftovers merged at the end.

Every partition keeps at most ``WINDOWS`` open containers for each capacity. An item goes where the least
room stays; if it fits nowhere and all windows are in use, the fullest container is closed. What is open at
the end of a partition is packed again, container by container, in ever fewer partitions. An item longer
than the capacity is divided into full containers and a rest that is packed like any other item.

Defined results: null and empty texts have no tokens and are not placed; an item as long as the capacity
fills a container alone; repeated items are placed each time; an empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut

WINDOWS = 128
#: Partitions are merged so many to one in each round of leftovers.
FAN_IN = 32


class Packer:
    """Open containers of one capacity: (room, name) in order, and what each holds."""

    def __init__(self, capacity: int, prefix: str, windows: int = WINDOWS):
        self.capacity, self.prefix, self.windows, self.made = capacity, prefix, windows, 0
        self.open: list[tuple[int, int]] = []

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def name(self, block: int) -> str:
        return f"{self.prefix}-{block}"

    def place(self, size: int) -> int:
        """The container that takes an item of at most the capacity."""
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, block = self.open.pop(i)
        else:
            if len(self.open) >= self.windows:
                self.open.pop(0)  # the fullest
            room, block = self.capacity, self.new()
        if room > size:
            insort(self.open, (room - size, block))
        return block


_ITEMS = "pack_name string, block string, doc_id long, piece int, from_token long, to_token long, leftover boolean"


def _first(packs: list[tuple[str, int]], windows: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packers = [(name, Packer(cap, f"{name}-{part}", windows)) for name, cap in packs]
        held: dict[tuple[str, int], list[tuple]] = {}
        out: list[list] = [[] for _ in range(7)]

        def emit(name: str, p: Packer, block: int, rows: list[tuple], leftover: bool) -> None:
            for doc, piece, a, b in rows:
                for col, v in zip(out, (name, p.name(block), doc, piece, a, b, leftover)):
                    col.append(v)

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _ITEMS.split(", ")])
            for c in out:
                c.clear()
            return batch

        for b in batches:
            for doc, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, p in packers:
                    at, piece = 0, 0
                    while size - at > p.capacity:
                        emit(name, p, p.new(), [(doc, piece, at, at + p.capacity)], False)
                        at, piece = at + p.capacity, piece + 1
                    if size > at:
                        block = p.place(size - at)
                        held.setdefault((name, block), []).append((doc, piece, at, size))
            for name, p in packers:
                still = {k for _, k in p.open}
                for key in [k for k in held if k[0] == name and k[1] not in still]:
                    emit(name, p, key[1], held.pop(key), False)
            if out[0]:
                yield flush()
        for name, p in packers:
            for key in [k for k in held if k[0] == name]:
                emit(name, p, key[1], held.pop(key), True)
        yield flush()

    return run


def _again(packs: list[tuple[str, int]], level: int, windows: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packers = {name: Packer(cap, f"{name}-m{level}-{part}", windows) for name, cap in packs}
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows.sort(key=lambda r: (-r[2], r[1]))  # bounded: FAN_IN partitions of at most WINDOWS containers
        got = [(name, block, packers[name].name(packers[name].place(size)), size) for name, block, size in rows]
        still = {p.name(k) for p in packers.values() for _, k in p.open}
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[2] in still for g in got], pa.bool_())],
            names=["pack_name", "block", "into", "size", "leftover"],
        )

    return run


def pack(items: DataFrame, packs: list[tuple[str, int]], windows: int = WINDOWS) -> DataFrame:
    """Lay ``doc_id, n_tokens`` items into containers of each ``(pack_name, capacity)``.

    Result: ``pack_name, block, doc_id, piece, from_token, to_token``.
    """
    packs = [(n, int(c)) for n, c in packs if c and c > 0]
    src = items.where(F.col("n_tokens") > 0).select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"))
    placed = cut(src.mapInArrow(_first(packs, windows), _ITEMS))
    final = placed.where(~F.col("leftover")).drop("leftover")
    rest = placed.where("leftover").drop("leftover")
    parts, level = placed.rdd.getNumPartitions(), 0
    while True:
        sizes = rest.groupBy("pack_name", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("size"))
        parts = max(1, parts // FAN_IN)
        spread = sizes.repartition(parts, F.xxhash64("block")) if parts > 1 else sizes.coalesce(1)
        merged = cut(spread.mapInArrow(_again(packs, level, windows if parts > 1 else 1 << 30), "pack_name string, block string, into string, size long, leftover boolean"))
        moved = rest.join(merged.drop("size", "pack_name"), "block").withColumn("block", F.col("into")).drop("into")
        columns = ["pack_name", "block", "doc_id", "piece", "from_token", "to_token"]
        if parts == 1:
            return final.unionByName(moved.select(columns))
        moved = cut(moved)
        final = final.unionByName(moved.where(~F.col("leftover")).select(columns))
        rest, level = moved.where("leftover").select(columns), level + 1


def report(placed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """Containers, tokens and the share of room used, for each capacity."""
    cap = F.create_map(*[x for n, c in packs for x in (F.lit(n), F.lit(int(c)))])
    used = placed.groupBy("pack_name").agg(
        F.countDistinct("block").alias("blocks"), F.countDistinct("doc_id").alias("documents"), F.sum(F.col("to_token") - F.col("from_token")).alias("tokens")
    )
    return used.withColumn("fill", F.round(F.col("tokens") / (F.col("blocks") * cap[F.col("pack_name")]), 6))
