"""Duplicates hidden by formatting differences: Merkle-style digests of nested records.

A record is a tree. Its text leaves keep only letters and digits, without case; JSON scalars keep type and
value; the children of an object are unordered (their digests are sorted), those of an array ordered.
Records with the same root digest are confirmed by comparing their whole canonical form, so a collision of
digests can't merge different records.

Defined results: a null leaf in a ``null_equals_empty`` field equals an empty one; a row whose required
field is null is never a copy; text that is no JSON is a leaf of its own kind; a record delivered twice
(same id) counts once; an empty table gives no groups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import bitmap, cut, hot_list, sift, spread_join


#: Size of the filter for digests of groups; beyond some ten million groups it lets everything through.
FILTER_BITS = 24


def plain(text: str | None) -> str:
    """Letters and digits in order, without case; null is the empty text."""
    return "".join(c for c in text.casefold() if c.isalnum()) if text else ""


def _hash(kind: bytes, *parts: bytes) -> bytes:
    h = blake2b(kind, digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(4, "big") + p)
    return h.digest()


def digest(value: object) -> bytes:
    """The digest of a parsed JSON value, from the leaves up."""
    if isinstance(value, dict):
        return _hash(b"{", *sorted(_hash(b":", k.encode("utf-8", "surrogatepass"), digest(v)) for k, v in value.items()))
    if isinstance(value, list):
        return _hash(b"[", *(digest(v) for v in value))
    if isinstance(value, str):
        return _hash(b"s", value.encode("utf-8", "surrogatepass"))
    if isinstance(value, bool) or value is None:
        return _hash(b"c", repr(value).encode())
    return _hash(b"i" if isinstance(value, int) else b"f", repr(value).encode())


class _Raw(str):
    """A leaf that is no JSON."""


def parse(text: str | None) -> object:
    if text is None:
        return _Raw("\0null")
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _Raw(text)


def canonical(texts: list[str], trees: list[object]) -> str:
    """The whole structure of a record in one text, the same for all copies."""
    return json.dumps([texts, [["raw", t] if isinstance(t, _Raw) else ["json", t] for t in trees]], sort_keys=True, ensure_ascii=False)


def root(texts: list[str], trees: list[object]) -> bytes:
    leaves = [_hash(b"t", str(i).encode(), t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts)]
    nodes = [_hash(b"r" if isinstance(t, _Raw) else b"j", str(i).encode(), digest(str(t) if isinstance(t, _Raw) else t)) for i, t in enumerate(trees)]
    return _hash(b"#", *sorted(leaves + nodes))


def _digests(batches: Iterator[pa.RecordBatch], n_text: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, *cols = (b.column(i).to_pylist() for i in range(b.num_columns))
        roots, forms = [], []
        for row in zip(*cols):
            texts, trees = [plain(t) for t in row[:n_text]], [parse(t) for t in row[n_text:]]
            roots.append(root(texts, trees))
            forms.append(canonical(texts, trees))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.binary()), pa.array(forms, pa.string())], names=["row_id", "digest", "form"])


def copies(df: DataFrame, required: str, texts: list[str], json_fields: list[str]) -> DataFrame:
    """``keep_id, row_id`` for every member of a group of at least two records, the keeper included.

    ``required`` (one of ``texts``) must not be null. Only digests and ids are shuffled to find groups. The
    canonical forms move once, and only those that a filter of fixed size lets through: members of groups and a
    few others by chance. A digest that holds a large share of all rows is counted by partial aggregation and
    joined with salt.
    """
    src = df.where(F.col(required).isNotNull() & F.col("row_id").isNotNull()).select("row_id", *texts, *json_fields)
    n_text = len(texts)
    hashed = cut(src.mapInArrow(lambda it: _digests(it, n_text), "row_id long, digest binary, form string"))
    counted = hashed.groupBy("digest").agg(F.min("row_id").alias("keep_id"), F.max("row_id").alias("__last"), F.count("*").alias("n"))
    groups = cut(counted.where(F.col("keep_id") < F.col("__last")).drop("__last"))
    hot = hot_list(groups, "digest")
    marks = bitmap(groups.select(F.xxhash64("digest").alias("__h")), "__h", FILTER_BITS)
    maybe = sift(hashed.withColumn("__h", F.xxhash64("digest")), "__h", marks, FILTER_BITS).drop("__h")
    members = cut(spread_join(maybe, groups.drop("n"), "digest", hot=hot))
    keepers = members.where(F.col("row_id") == F.col("keep_id")).groupBy("digest").agg(F.min("form").alias("keep_form"))
    compared = spread_join(members, keepers, "digest", hot=hot)
    same = F.col("form") == F.col("keep_form")
    agreed = compared.where(same).select("keep_id", "row_id")
    rest = compared.where(~same).select("form", "row_id")  # collisions only: grouped by the form itself
    apart = rest.join(rest.groupBy("form").agg(F.min("row_id").alias("keep_id")), "form").select("keep_id", "row_id")
    return agreed.unionByName(apart).distinct()
