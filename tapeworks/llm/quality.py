"""Operator 8: quality rules with compression bands.

The zstandard ratio (bytes over compressed bytes) of the whole text and of each of its fixed chunks must lie within a
band that depends on the length: short texts compress little whatever they say, long ones more.  A ratio above the band
marks repetition or few kinds of words, one below it random or encoded matter.

``fit_bands`` fits the bands to documents labelled for quality: the usual ratio at each length is the median of the
good ones, by half octaves, and beyond the longest of these a line through the last ``TREND`` medians, so that a text
of any length is judged; limits are in parts of it.  An upper limit is where keeping good documents
(``GOOD_COUNTS`` times) and rejecting the others goes best; the lower ones lie half as far again below 1 as the lowest
good document.  It learns from every labelled document whose ``crc32(doc_id)`` isn't divisible by 5; of a repeated id,
from its least text.  Medians and upper limits come from counts of all documents by steps of 1 / ``STEPS`` octave, so
that what is collected is bounded.  Without ``LEAST_GOOD`` good documents (for the chunks' limits: with a chunk) the
bands are ``DEFAULT``, which are wide.

Chunks are full: the last one of a text ends where the text does, and so overlaps the one before.  A text shorter
than a chunk has the whole as its only chunk, and that is judged as the whole.

A null or empty text has no words, ratio 1 and fails the base rules.  A very long text is judged like others, chunk by
chunk.  Repeated rows are each judged alike; rows without an id are judged and teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, free_name
from tapeworks.llm.words import append_columns

#: Bytes of a chunk.
CHUNK_BYTES = 4096
LEVEL = 3
#: Good documents needed; how much a good one counts.
LEAST_GOOD, GOOD_COUNTS = 50, 5
#: Steps of an octave by which lengths and ratios are counted.
STEPS = 4096
#: Medians that the line for longer texts goes through: two octaves of them.
TREND = 4
_SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """The usual ratio by log2 of the bytes (interpolated), and limits in parts of it, of whole texts and of chunks."""

    knots: tuple[float, ...]
    usual: tuple[float, ...]
    whole: tuple[float, float]
    chunk: tuple[float, float]
    rise: float  # of the usual ratio with each doubling beyond the last knot

    def usual_at(self, size: Column) -> Column:
        """The usual ratio of so many bytes."""
        x = F.log2(F.greatest(size, F.lit(1)))
        out = F.when(x <= self.knots[0], self.usual[0])
        for a, b, u, v in zip(self.knots, self.knots[1:], self.usual, self.usual[1:]):
            out = out.when(x <= b, u + (v - u) / (b - a) * (x - a))
        return out.otherwise(self.usual[-1] + self.rise * (x - self.knots[-1]))


DEFAULT = Bands((8.0, 10.0, 12.0, 14.0, 16.0), (1.5, 1.9, 2.2, 2.4, 2.6), (0.5, 3.0), (0.5, 3.0), 0.1)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # bytes.split() parts at the six ASCII white spaces alone
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(grams)) < len(grams):
        count, covered = Counter(grams), 0
        for i, g in enumerate(grams):
            if count[g] > 1:
                repeat += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), len(text) - spaces, len(_SYMBOLS.findall(text)), dup, repeat


def ratios(raw: bytes, compress) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole, and (bytes, ratio) of each full chunk; the last one ends with the text."""
    last = len(raw) - CHUNK_BYTES
    starts = [*range(0, last, CHUNK_BYTES), last] if last >= 0 else []
    parts = [raw[i : i + CHUNK_BYTES] for i in starts]
    return len(raw) / len(compress(raw)) if raw else 1.0, [(len(p), len(p) / len(compress(p))) for p in parts]


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress


def _failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def measured(docs: DataFrame, text: str, size: str, low: str, high: str) -> DataFrame:
    """docs with the base counts, ``base_failed`` and ``whole_ratio``, the bytes, and the least and the highest ratio of a chunk."""
    fields = {k: "bigint" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    fields |= {"base_failed": "boolean", "whole_ratio": "double", size: "bigint", low: "double", high: "double"}

    def work(texts: pa.Array, compress) -> list:
        out = []
        for t in texts.to_pylist():
            raw = (t or "").encode()
            counts = base_counts(t or "")
            whole, chunks = ratios(raw, compress)
            chunks = [r for _, r in chunks]
            out.append((*counts, _failed(counts), whole, len(raw), min(chunks, default=None), max(chunks, default=None)))
        return [[x[i] for x in out] for i in range(len(fields))]

    return append_columns(docs, text, fields, work, _compressor)


def _judged(found: DataFrame, bands: Bands, size: str, low: str, high: str) -> DataFrame:
    """found with ``least_chunk`` and ``most_chunk`` (parts of the usual ratio) and ``kept``."""
    of_chunk = bands.usual_at(F.lit(CHUNK_BYTES))
    out = found.withColumns({"least_chunk": F.col(low) / of_chunk, "most_chunk": F.col(high) / of_chunk})
    whole = (F.col("whole_ratio") / bands.usual_at(F.col(size))).between(*bands.whole)
    chunk = F.col("least_chunk").isNull() | (F.col("least_chunk") >= bands.chunk[0]) & (F.col("most_chunk") <= bands.chunk[1])
    return out.withColumn("kept", ~F.col("base_failed") & whole & chunk).drop(size, low, high)


def _step(value: Column) -> Column:
    return F.floor(F.log2(value) * STEPS)


def _medians(good: DataFrame, value: str) -> dict[int, tuple[float, int]]:
    """Median step of a column and number of documents, by half octave of the size; at most some dozens of them."""
    n = good.groupBy("half", _step(F.col(value)).alias("step")).agg(F.count("*").alias("n"))
    return {r.half: (r.median / STEPS, r.n) for r in n.groupBy("half").agg(F.percentile("step", 0.5, F.col("n")).alias("median"), F.sum("n").alias("n")).collect()}


def _upper(found: DataFrame, part: Column) -> float:
    """The limit with the least cost of good ones above and bad ones below it, midway to the next; none of the good without bad ones."""
    own = found.select("good", part.alias("part")).where("part is not null")
    rows = own.groupBy(_step(F.col("part")).alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.max("part").alias("most"))
    got = sorted(rows.collect(), key=lambda r: r.step)  # STEPS for each octave that parts span
    good, bad = np.array([r.good for r in got]), np.array([r.bad for r in got])
    if not bad.any():
        return 1 + 1.5 * (got[-1].most - 1)
    cost = GOOD_COUNTS * (good.sum() - np.cumsum(good)) + np.cumsum(bad)
    i = int(np.argmin(cost))
    middle = lambda r: 2 ** ((r.step + 0.5) / STEPS)
    return float((middle(got[i]) + middle(got[i + 1])) / 2) if i + 1 < len(got) else 1 + 1.5 * (got[i].most - 1)


def _least_of_ids(found: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """A row of each id: that of its least text.  Texts are looked at again only where an id has several."""
    twice = cut(found.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("doc_id"))
    if not twice.isEmpty():
        least = docs.join(twice, "doc_id").groupBy("doc_id").agg(digest(F.min(F.coalesce("text", F.lit("")))).alias("least"))
        found = found.join(least, "doc_id", "left").where(F.col("least").isNull() | (F.col("least") == F.col(key))).drop("least")
    return found.dropDuplicates(["doc_id"])


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _bands(found: DataFrame, docs: DataFrame, labels: DataFrame) -> Bands:
    """Bands from measured rows (doc_id, key, size, low, high and others) of docs."""
    own = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    own = own.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    found = found.select("doc_id", "key", "base_failed", "whole_ratio", "size", "low", "high").join(own, "doc_id")
    found = cut(_least_of_ids(cut(found), docs, "key").where("not base_failed").withColumn("good", F.col("quality") == 1).withColumn("half", F.floor(2 * F.log2("size"))))
    good = found.where("good")
    x, ratio = _medians(good, "size"), _medians(good, "whole_ratio")
    halves = sorted(h for h in x if x[h][1] >= 8)
    if sum(n for _, n in x.values()) < LEAST_GOOD or len(halves) < 2:
        return DEFAULT
    knots, usual = tuple(x[h][0] for h in halves), tuple(2 ** ratio[h][0] for h in halves)
    rise = max(float(np.polyfit(knots[-TREND:], usual[-TREND:], 1)[0]), 0.0)
    line = Bands(knots, usual, (0, 9), (0, 9), rise)
    part, of_chunk = F.col("whole_ratio") / line.usual_at(F.col("size")), line.usual_at(F.lit(CHUNK_BYTES))
    ends = good.agg(F.min(part).alias("whole"), F.min(F.col("low") / of_chunk).alias("chunk"), F.count("low").alias("n")).first()
    lower = lambda v: 1 - 1.5 * (1 - min(v, 1))
    chunk = (lower(ends.chunk), _upper(found, F.col("high") / of_chunk)) if ends.n >= LEAST_GOOD else DEFAULT.chunk
    return Bands(knots, usual, (lower(ends.whole), _upper(found, part)), chunk, rise)


def fit_bands(docs: DataFrame, labels: DataFrame) -> Bands:
    """Bands fitted to all of docs (doc_id, text) that labels (doc_id, quality) cover; base failures are left out."""
    docs = docs.select("doc_id", "text")
    return _bands(measured(docs.withColumn("key", digest(F.col("text"))), "text", "size", "low", "high"), docs, labels)


def rules(docs: DataFrame, bands: Bands = DEFAULT, text: str = "text") -> DataFrame:
    """docs with the base counts, ``base_failed``, ``whole_ratio``, ``least_chunk`` and ``most_chunk`` (parts of the usual ratio) and ``kept``.

    Columns of docs with these names are replaced.
    """
    names = free_name(docs, "__size", "__low", "__high")
    return _judged(measured(docs, text, *names), bands, *names)


def op8_compression_bands(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found = cut(measured(docs.withColumn("key", digest(F.col("text"))), "text", "size", "low", "high").drop("text"))
    return _judged(found, _bands(found, docs, labels), "size", "low", "high").drop("key")
