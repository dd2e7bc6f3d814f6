"""Counting and encoding with the public tokenizers; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are unless GRISTMILL_TOKENIZERS says otherwise.
FOLDER = os.environ.get("GRISTMILL_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that the byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, Callable] = {}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encode a batch of texts; loaded once per worker. Special strings in a text are ordinary text."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [enc.encode_ordinary(t) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: sp.encode(texts, num_threads=1)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _loaded[path] = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


#: Longer texts are encoded in pieces cut at line ends or spaces, so that no call is very long.
PIECE = 200_000


def pieces(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PIECE:
        end = max(text.rfind(c, at + PIECE // 2, at + PIECE) for c in "\n ")
        end = end if end > at else at + PIECE
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def encode(path: str, texts: list[str | None]) -> list[list[int]]:
    """Token ids of whole texts; null gives none."""
    enc = encoder(path)
    plain = [t if t is not None else "" for t in texts]
    if all(len(t) <= PIECE for t in plain):
        return enc(plain)
    return [sum(enc(pieces(t)), []) for t in plain]


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """All columns but the text, and its number of tokens; null texts have 0."""
    path = f"{folder}/{tokenizer}"

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            i = b.schema.names.index(text)
            n = [len(x) for x in encode(path, b.column(i).to_pylist())]
            keep = [k for k in range(b.num_columns) if k != i]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], names=[*(b.schema.names[k] for k in keep), out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != text)
    return df.withColumn(text, F.col(text).cast("string")).mapInArrow(run, f"{schema}`{out}` long")
