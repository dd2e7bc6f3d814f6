"""JSON lines and packed token shards."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import pieces_of


def read_text_lines(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """``value, path, reason, text``: every non-blank line with why it has no usable text (null if it has).

    Reasons: bad_json, no_field, non_str, empty. A number in the field is not text. ``.gz`` is read too.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.col("value").rlike(r"\S"))
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    text = F.try_variant_get(v, f"$.{field}", "string")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    reason = (
        F.when(v.isNull(), "bad_json")
        .when(~is_object | kind.isNull(), "no_field")
        .when(kind != "STRING", "non_str")
        .when(F.length(text) == 0, "empty")
    )
    return raw.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), text))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_zst_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, path`` of every line of zstd-compressed files, decompressed as a stream on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)), "utf-8", "replace")
                part: list[str] = []
                for line in lines:
                    part.append(line.rstrip("\n"))
                    if len(part) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([name] * len(part))], names=["value", "path"])
                        part = []
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([name] * len(part), pa.string())], names=["value", "path"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "value string, path string")


def pick_text(df: DataFrame, wanted: str = "text") -> str | None:
    """The requested column or the first usual text column, else the first string column."""
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return next((c for c in (wanted, "text", "content", "article", "raw", "completion", "code", "data") if c in strings), strings[0] if strings else None)


def parse_weights(specs: list[str]) -> list[tuple[str, float]]:
    """``path:weight`` specs, weights positive and scaled to 1."""
    out = []
    for s in specs:
        path, _, w = s.rpartition(":")
        weight = float(w)
        if not path or weight <= 0:
            raise ValueError(f"bad source {s!r}: need path:weight with a positive weight")
        out.append((path, weight))
    total = sum(w for _, w in out)
    return [(p, w / total) for p, w in out]


def notebook_code(raw: str | None) -> str | None:
    """The code cells of a notebook, joined; null where it is none."""
    try:
        cells = json.loads(raw or "").get("cells", [])
        code = ["".join(c["source"]) if isinstance(c["source"], list) else str(c["source"]) for c in cells if c.get("cell_type") == "code"]
        return "\n\n".join(x for x in code if x.strip()) or None
    except (ValueError, AttributeError, KeyError, TypeError):
        return None


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines without internal columns (leading underscore); nulls survive; the commit is atomic."""
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_verdicts(df: DataFrame, path: str, reasons: str, repairable: str) -> None:
    """One pass: folders verdict=pass, reject and repair."""
    verdict = F.when(F.size(reasons) == 0, "pass").when(F.col(repairable), "repair").otherwise("reject")
    df.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").json(path)


def write_shards(df: DataFrame, ids: str, folder: str, vocab: int, per_shard: int) -> DataFrame:
    """Packed ``.bin`` shards of exactly ``per_shard`` ids each (the last one shorter) in row order, and their sizes.

    ``df`` has ``row_id`` and the ids. Ids are uint16, or uint32 for large vocabularies; an id outside the
    vocabulary fails the write. ``folder`` is a path or URI of a file system that all machines share. A shard is
    written under another name and then moved, so a task that is run again replaces it.
    """
    kind = "<u2" if vocab <= 65_536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1)):
                flat = x.values.to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= vocab):
                    raise ValueError("token id out of range")
                name = f"{root}/shard_{block:06d}.bin"
                tmp = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                with system.open_output_stream(tmp) as f:
                    f.write(flat.astype(kind).tobytes())
                system.move(tmp, name)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(flat)], pa.int64())], names=["shard", "tokens"])

    cut_up = pieces_of(df.select("row_id", F.col(ids).alias("ids")), "ids", per_shard, [])
    return cut_up.select(F.col("block").cast("long"), "ids").mapInArrow(run, "shard string, tokens long")


def _file_system(folder: str):  # noqa: ANN202
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def read_shards(spark: SparkSession, path: str, block: int, wide: bool = False, keep_rest: bool = False) -> DataFrame:
    """``path, block, ids`` of packed shards in blocks; a remainder is dropped unless it is asked for. (A shard is
    one cell; its size is fixed when it is written.)"""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(data, kind).astype(np.int32)
                parts = [x[i : i + block] for i in range(0, len(x), block)]
                if parts and len(parts[-1]) < block and not keep_rest:
                    parts.pop()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["path", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, block long, ids array<int>")


def shard_kind(meta: dict | None) -> bool:
    """Whether shards are wide (uint32), as their manifest says; without one they are not."""
    return str((meta or {}).get("dtype", "uint16")) == "uint32"


def manifest(sizes: list[tuple[str, int]], targets: dict[str, int], vocab: int) -> dict:
    """What a build leaves beside its shards: kind of ids, totals, targets, shards and their sizes."""
    return {"dtype": "uint16" if vocab <= 65_536 else "uint32", "vocab": vocab, "tokens": sum(n for _, n in sizes), "targets": targets, "shards": [{"name": os.path.basename(s), "tokens": n} for s, n in sorted(sizes)]}


def parse_spec(spec: str) -> tuple[str, float, str]:
    """``path:value``: a ratio (below or equal to 1, with a point) or a count."""
    path, _, value = spec.rpartition(":")
    if not path or not value:
        raise ValueError(f"bad spec {spec!r}: need path:value")
    number = float(value)
    if number <= 0:
        raise ValueError(f"bad spec {spec!r}: the value must be positive")
    return path, number, "ratio" if number <= 1 and "." in value else "count"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics log without its bad lines; a missing kind is val where there is a val_loss, else train."""
    raw = spark.read.option("mode", "PERMISSIVE").schema("kind string, step long, loss double, val_loss double, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    kind = F.coalesce("kind", F.when(F.col("val_loss").isNotNull(), "val").otherwise("train"))
    return raw.where(F.col("_bad").isNull() & F.col("step").isNotNull()).drop("_bad").withColumn("kind", kind)
