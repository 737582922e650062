"""Vectorised word work on Arrow text batches: splitting, hashing, slicing.

Words are the runs of bytes outside ASCII white space (``[^\\x20\\x09-\\x0D]+``), lower-cased over A-Z only, so a
word is the same in every locale.  A word's 64-bit hash is a polynomial over random byte values, computed for a
whole slice of texts at once by one cumulative sum; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tapeworks.llm.shared import small_batches

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a slice of texts, in order."""

    data: np.ndarray  # bytes of the slice, lower-cased if asked for
    n_texts: int
    text_start: np.ndarray  # byte at which each text starts, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    text: np.ndarray  # index of the text of each word
    first: np.ndarray  # index of each text's first word, and the number of words
    hash: np.ndarray  # uint64


def split_words(texts: pa.StringArray | pa.LargeStringArray, lower: bool = True) -> Words:
    """Words and their hashes, lower-cased unless told otherwise; a null text has none."""
    texts = pa.array([], pa.large_string()) if not len(texts) else texts.cast(pa.large_string()).fill_null("")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8, count=hi)[lo:] if hi > lo else np.zeros(0, np.uint8)
    data = _LOWER[data] if lower else data
    at = offsets - lo
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    text = np.repeat(np.arange(n), np.diff(first))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=total[1:])
    h = mix((total[end] - total[start]) * _powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
    return Words(data, n, at, start, end, text, first, h)


def windows(h: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values of h (len(h) - size + 1 of them)."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, np.uint64(seed), dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in a text column at most, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def gather(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition again, in blocks of about ``limit`` bytes of text."""
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, limit):
            held.append(part)
            size += (pc.sum(pc.binary_length(part.column(column))).as_py() or 0) + 16 * part.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def finder(pattern: str):
    r"""``findall`` for a split pattern over ``\p{L}``, ``\p{N}`` and ``\s`` (White_Space).

    Texts within Latin-1 take the same pattern with these classes spelled out, which the re module runs faster.
    """
    import re

    import regex

    latin = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\x09-\x0D\x20\x85\xA0"}

    def spell(inside: bool):
        return lambda m: latin[m[0]] if inside else f"[{latin[m[0]]}]"

    def plain(p: str) -> str:
        p = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", spell(True), m[0]), p)
        p = p.replace(r"\S", rf"[^{latin[chr(92) + 's']}]")
        return re.sub(r"(\[[^\]]*\])|\\p\{[LN]\}|\\s", lambda m: m[1] or spell(False)(m), p)

    exact = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    whole, short = regex.compile(exact).findall, re.compile(plain(pattern)).findall

    def find(text: str) -> list[str]:
        if text.isascii():
            return short(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return short(text)

    return find


_KEPT: dict = {}


def per_worker(make, *key):
    """make(*key), made once in each Python worker and kept for its later tasks."""
    k = (make.__module__, make.__qualname__, *key)
    if k not in _KEPT:
        _KEPT.clear()  # a worker serves one operator at a time
        _KEPT[k] = make(*key)
    return _KEPT[k]


def replace_columns(df, text: str, fields: dict[str, str], work, setup=None, limit: int = SLICE_BYTES):
    """df with the columns that ``work(batch[, state])`` computes for each slice, in the tasks that read df.

    fields: name and DDL type of each new column; a column of df with such a name (in any case) is replaced.
    work returns one Arrow array or sequence for each field.  setup, if given, gives the state once for each task.
    Slices hold about ``limit`` bytes of the text column, or one row.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    taken = {k.lower() for k in fields}
    keep = [c for c in df.columns if c.lower() not in taken]
    types = [f.type for f in to_arrow_schema(new)]
    names = [*keep, *fields]

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch, text, limit):
                got = work(part, state) if setup else work(part)
                made = [x.cast(t) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names)
                del got, made
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *new]))


def append_columns(df, text: str, fields: dict[str, str], work, setup=None, limit: int = SLICE_BYTES):
    """As replace_columns, for work that needs the text column alone: ``work(texts[, state])``."""

    def own(part, *state):
        return work(part.column(text), *state)

    return replace_columns(df, text, fields, own, setup, limit)
