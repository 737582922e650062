"""Operator 5: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file's byte tokens become a ``tokenizers`` BPE model over the usual byte-to-character table.  Each match of
the split pattern is encoded on its own; a task keeps the ids of the pieces it has met, so the library sees each new
piece once.  Decoding reverses the byte table; a token that holds part of a character gives bytes that only complete
with its neighbours, so decoding returns bytes, and text only through ``errors="replace"``.

Nulls and empty texts have no ids; ids that the vocabulary lacks raise an error on decoding.  A very long text is a
slice of its own, whose pieces a worker holds at once; repeated rows and rows without an id are encoded each for itself.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.words import append_columns, finder, per_worker

#: Pieces whose ids a task keeps; the cache starts anew beyond it.
CACHE_PIECES = 400_000


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PieceCache(dict):
    """ids of pieces as little-endian uint32 bytes; pieces not met before go to the library together."""

    def __init__(self, tokenizer, limit: int = CACHE_PIECES):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit

    def learn(self, pieces: set[str]) -> None:
        if len(self) > self.limit:
            self.clear()
        new = [p for p in pieces if p not in self]
        got = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(got.ids, dtype="<u4"), np.array(got.word_ids, dtype=np.int64)
        at = np.searchsorted(of, np.arange(len(new) + 1)) * 4
        raw = ids.tobytes()
        for i, p in enumerate(new):
            self[p] = raw[at[i] : at[i + 1]]

    def encode(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return b"".join(map(self.__getitem__, pieces))


def byte_bpe(ranks: dict[bytes, int]):
    """A tokenizers pipeline that merges by rank: every split of a token into two known parts is a merge."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_table()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [
        (name[t[:i]], name[t[i:]])
        for t, r in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(t))
        if ranks.get(t[:i], r) < r and ranks.get(t[i:], r) < r
    ]
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out


def encoder(path: str, pattern: str) -> tuple:
    """What finds the pieces of a text, the ids of those met so far, and the bytes in each token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for t, r in ranks.items():
        size[r] = len(t)
    return finder(pattern), PieceCache(byte_bpe(ranks)), size


def token_offsets(text: str, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; a split character belongs to all its tokens."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(size[ids])
    return char[end - size[ids]], char[end - 1] + 1


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """df with ``ids`` (binary, little-endian uint32) and, if asked for, ``starts`` and ``ends`` in characters.

    A null text gives empty ids.  Every row stays, repeated ones too; columns of df with these names are replaced.
    """
    fields = {"ids": "binary"} | ({"starts": "array<int>", "ends": "array<int>"} if offsets else {})

    def work(texts: pa.Array, state) -> list:
        find, cache, size = state
        texts = ["" if t is None else t for t in texts.to_pylist()]
        ids = [cache.encode(find(t)) for t in texts]
        if not offsets:
            return [pa.array(ids, pa.binary())]
        spans = [token_offsets(t, np.frombuffer(b, dtype="<u4"), size) for t, b in zip(texts, ids)]
        return [pa.array(ids, pa.binary()), [a for a, _ in spans], [b for _, b in spans]]

    return append_columns(df, text, fields, work, lambda: per_worker(encoder, path, pattern))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded``: the bytes of the ids (binary).  Null ids decode to no bytes."""

    def setup():
        ranks = read_ranks(path)
        table: list = [None] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            table[r] = t
        return table.__getitem__

    def work(column: pa.Array, token) -> list:
        return [pa.array([b"".join(map(token, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in column.to_pylist()], pa.binary())]

    return append_columns(df, ids, {"decoded": "binary"}, work, setup)


def decoded_text(decoded: F.Column) -> F.Column:
    """The decoded bytes as text; bytes of a character that is cut become U+FFFD."""
    return F.decode(decoded, F.lit("UTF-8"))


def op5_byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
