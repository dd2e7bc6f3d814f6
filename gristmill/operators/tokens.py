"""Token streams: encoding, blocks, masks, first-token counts, padding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import DEFAULT, FOLDER, encode
from .rows import running_total


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """All columns but the text, and its token ids (none for null)."""
    path = f"{folder}/{tokenizer}"

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            i = b.schema.names.index(text)
            keep = [k for k in range(b.num_columns) if k != i]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(encode(path, b.column(i).to_pylist()), pa.list_(pa.int32()))], names=[*(b.schema.names[k] for k in keep), out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != text)
    return df.mapInArrow(run, f"{schema}`{out}` array<int>")


def with_ends(ids: Column, bos: int | None, eos: int | None) -> Column:
    """BOS and EOS once each, also where the ids already have them."""
    x = ids
    if bos is not None:
        x = F.when(F.try_element_at(x, F.lit(1)) == bos, x).otherwise(F.concat(F.array(F.lit(bos)), x))
    if eos is not None:
        x = F.when(F.try_element_at(x, F.lit(-1)) == eos, x).otherwise(F.concat(x, F.array(F.lit(eos))))
    return x


def fit(ids: Column, length: int, pad: int) -> Column:
    """Cut to the last ``length`` ids or pad at the end."""
    kept = F.when(F.size(ids) > length, F.slice(ids, F.lit(-length), F.lit(length))).otherwise(ids)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(kept), F.lit(0))))


def in_range(ids: Column, vocab: int) -> Column:
    return F.forall(ids, lambda x: (x >= 0) & (x < vocab))


def loss_mask(ids: Column, bos: int, eos: int) -> Column:
    """1 where a label counts: not BOS, not a repeated EOS, not the last one. Labels are the ids after the first."""
    labels = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))

    def mask(both: Column) -> Column:
        n = F.size(both)
        return F.transform(both, lambda x, i: F.when((x == bos) | (i == n - 1) | ((x == eos) & (i > 0) & (F.get(both, i - 1) == eos)), 0).otherwise(1))

    return F.transform(F.array(labels), mask)[0]


def blocks(df: DataFrame, ids: str, length: int, by: list[str], row_id: str = "row_id") -> DataFrame:
    """Documents laid end to end within ``by`` in row order and cut into blocks of ``length`` ids; the
    remainder is dropped. Only the pieces of a document that lie in different blocks are exploded."""
    return pieces_of(df, ids, length, by, row_id).where(F.size("ids") == length)


def first_tokens(df: DataFrame, ids: str, by: str, k: int) -> DataFrame:
    """The k most frequent first ids overall (``by`` null) and for each source."""
    from pyspark.sql import Window as W

    n = df.where(F.size(ids) > 0).groupBy(by, F.col(ids)[0].alias("token")).agg(F.count("*").alias("n"))
    both = n.unionByName(n.groupBy("token").agg(F.sum("n").alias("n")).withColumn(by, F.lit(None).cast("string")))
    return both.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= k)


class ChatIds(NamedTuple):
    """Ids of the marks around turns; they must lie outside the vocabulary of texts (or be reserved in it)."""

    bos: int
    system: int
    user: int
    assistant: int
    eos: int


#: The label of a position that is not supervised.
IGNORED = -100


def encode_chat(df: DataFrame, messages: str, marks: ChatIds, cue: bool = False, tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """All columns but the messages, and ``ids`` and ``labels``: BOS, then for each turn its role's id and its
    content; EOS closes an assistant's turn. Labels repeat the ids of answers and their EOS and are ``IGNORED``
    elsewhere. With ``cue``, the ids end in the assistant's mark (a prompt). Marks written in a text stay text.
    Null or empty messages give BOS alone.
    """
    path, roles = f"{folder}/{tokenizer}", {"system": marks.system, "user": marks.user, "assistant": marks.assistant}

    def one(turns: list, coded: Iterator[list[int]]) -> tuple[list[int], list[int]]:
        ids, labels = [marks.bos], [IGNORED]
        for m in turns:
            x = next(coded)
            ids += [roles[m["role"]], *x]
            labels.append(IGNORED)
            if m["role"] == "assistant":
                ids.append(marks.eos)
                labels += [*x, marks.eos]
            else:
                labels += [IGNORED] * len(x)
        if cue:
            ids.append(marks.assistant)
            labels.append(IGNORED)
        return ids, labels

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            i = b.schema.names.index(messages)
            keep = [k for k in range(b.num_columns) if k != i]
            chats = [[m for m in c or () if m and m["role"] in roles] for c in b.column(i).to_pylist()]
            coded = iter(encode(path, [m["content"] for c in chats for m in c]))
            both = [one(c, coded) for c in chats]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([x for x, _ in both], kind), pa.array([y for _, y in both], kind)], names=[*(b.schema.names[k] for k in keep), "ids", "labels"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != messages)
    return df.mapInArrow(run, f"{schema}ids array<int>, labels array<int>")


def pieces_of(df: DataFrame, ids: str, length: int, by: list[str], row_id: str = "row_id") -> DataFrame:
    """Documents laid end to end within ``by`` in row order and cut into runs of ``length`` ids, the last one
    shorter: ``by, block, ids``."""
    run = running_total(df.where(F.size(ids) > 0), by, F.size(ids), "__from", row_id)
    first, last = F.floor(F.col("__from") / length), F.floor((F.col("__from") + F.size(ids) - 1) / length)
    parts = run.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * length - F.col("__from"), F.lit(0))
    hi = F.least((F.col("block") + 1) * length - F.col("__from"), F.size(ids).cast("long"))
    piece = parts.select(*by, "block", F.struct(F.col("__from"), F.slice(ids, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x")).alias("p"))
    # at most ``length`` ids come together
    return piece.groupBy(*by, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"])).alias("ids"))
