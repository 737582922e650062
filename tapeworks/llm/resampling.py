"""Operator 11: importance resampling towards a target distribution.

An untrained ``Split`` of the tokenizers library over the text, lower-cased in A-Z alone, gives words with their
offsets.  Windows of offset pairs are the features (runs of words, joined by one space); each falls into a bucket by the CRC-32
of its bytes.  The bucket histograms of all documents and of the target texts give each bucket a gain, the logarithm of how much
more often the target holds it; a document's weight is the mean gain of its features.  With Gumbel noise from its id
added, the highest scores are a draw without replacement in proportion to the weights.

Texts are split once: a document's buckets, two bytes a feature, are written as a table in the shared folder, from which the histogram is
counted (``n_buckets`` rows a task at most) and the gains are summed.  What the driver sees are both histograms, the number of documents at each score
(scores are whole thousandths of logarithms, so there are some ten thousands of them whatever the number of documents)
and the number of rows of each sorted part.  Only documents that are drawn are sorted, by range.

A null text has no words: its weight is 0, and it isn't drawn.  Very long texts are split ``PIECE_CHARS`` at a time, between words.
A row without an id takes the empty string for it and ranks behind others of its score; repeated rows are each drawn by themselves, in
any order among themselves.  Other columns play no part.  No target texts leave the gains to the documents alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, drop_cut
from tapeworks.llm.words import replace_columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Runs of so many words at most are features; buckets; words that a document needs to be drawn; percent that are drawn.
RUN, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10
SEED = "2024"
PIECE_CHARS = 1_000_000
#: Features whose bucket a task remembers: so many, none of them longer than this.
REMEMBERED, SHORT = 300_000, 64


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text, of about ``limit`` characters, none of which ends within a word."""
    at = 0
    while at < len(text):
        end = NO_WORD.search(text, at + limit) if at + limit < len(text) else None
        to = end.end() if end else len(text)
        yield text[at:to] if at or to < len(text) else text
        at = to


def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str


def _buckets(run: int, n_buckets: int):
    """A function of a text: the buckets of its features, and its number of words."""
    split, known = _splitter(), {}

    def bucket(feature: str) -> int:
        got = known.get(feature)
        if got is None:
            got = zlib.crc32(feature.encode()) % n_buckets
            if len(feature) <= SHORT and len(known) < REMEMBERED:
                known[feature] = got
        return got

    def of(text: str) -> tuple[list[int], int]:
        out, n, before = [], 0, []
        for piece in pieces(text.lower() if text.isascii() else text.encode().lower().decode()):
            found = split(piece)
            n += len(found)
            if run == 1:
                out += [bucket(piece[a:b]) for _, (a, b) in found]
                continue
            words = before + [piece[a:b] for _, (a, b) in found]
            for size in range(1, run + 1):
                first = max(0, len(before) - size + 1)  # windows that end in this piece
                out += [bucket(" ".join(words[i : i + size])) for i in range(first, len(words) - size + 1)]
            before = words[len(words) - run + 1 :]
        return out, n

    return of


def featured(docs: DataFrame, text: str, run: int, n_buckets: int) -> DataFrame:
    """docs with the text column replaced by the buckets of its features (binary, in order of place), ``n_features`` and ``n_words``."""
    kind = "<u2" if n_buckets <= 2**16 else "<u4"

    def work(batch: pa.RecordBatch, of) -> list:
        got = [of(t or "") for t in batch.column(text).to_pylist()]
        return [[np.array(b, dtype=kind).tobytes() for b, _ in got], [len(b) for b, _ in got], [n for _, n in got]]

    return replace_columns(docs, text, {text: "binary", "n_features": "bigint", "n_words": "bigint"}, work, lambda: _buckets(run, n_buckets))


def _flat(column: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column, and how many each row has."""
    raw = column.to_pylist()
    size = 2 if n_buckets <= 2**16 else 4
    return np.frombuffer(b"".join(raw), dtype=f"<u{size}").astype(np.int64), np.array([len(r) // size for r in raw], dtype=np.int64)


def histogram(featured: DataFrame, column: str, n_buckets: int) -> np.ndarray:
    """How many features fall into each bucket."""

    def run(batches):
        n = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            n += np.bincount(_flat(batch.column(column), n_buckets)[0], minlength=n_buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    out = np.zeros(n_buckets, dtype=np.int64)
    for r in featured.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # n_buckets rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in whole thousandths of a logarithm."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighted(featured: DataFrame, column: str, gain: np.ndarray) -> DataFrame:
    """featured with the buckets' column replaced by ``weight``: the floored mean gain of the row's features, 0 without any."""

    def work(batch: pa.RecordBatch) -> list:
        flat, n = _flat(batch.column(column), len(gain))
        total = np.concatenate([[0], np.cumsum(gain[flat])])
        end = np.cumsum(n)
        return [(total[end] - total[end - n]) // np.maximum(n, 1)]

    return replace_columns(featured, column, {"weight": "bigint"}, work).drop(column)


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank is null for rows that aren't drawn.

    Of the rows with least_words words or more, percent (rounded down) are drawn.  target: the texts (column text) that the draw should be like.
    """
    own = featured(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("buckets")), "buckets", run, n_buckets)
    own = cut(own)
    gain = gains(histogram(own, "buckets", n_buckets), histogram(featured(target.select(F.col(text).alias("buckets")), "buckets", run, n_buckets), "buckets", n_buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(weighted(own, "buckets", gain).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    drop_cut(own)

    may = F.col("n_words") >= least_words
    at_score = sorted(((r.score, r.n) for r in scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # as many as scores differ
    wanted = percent * sum(n for _, n in at_score) // 100
    least, above = None, 0
    for s, n in at_score:
        if above >= wanted:
            break
        least, above = s, above + n
    names = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    near = may & (F.col("score") >= least)
    ordered = scored.where(near).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row").withColumn("at", F.monotonically_increasing_id())
    ordered = cut(ordered.select(*names, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("place")))
    before, starts = 0, []
    for r in sorted(ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each sorted part
        starts.append((r.part, before))
        before += r.n
    start = F.broadcast(scored.sparkSession.createDataFrame(starts, "part long, start long"))
    rank = F.col("start") + F.col("place") + 1
    ranked = ordered.join(start, "part").select(*names, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scored.where(~near).select(*names, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs.select("doc_id", "text"), benchmark.select("text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
dw AS (SELECT doc_id, unnest(words) AS word FROM d),
bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
n AS (
  SELECT word, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM (SELECT word, 'd' AS side FROM dw UNION ALL SELECT word, 'b' FROM bw) GROUP BY word),
crc_bits AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) r(i)),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits),
crc AS (
  SELECT word, s, t,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(word)), lambda i: CAST(concat('0x', substr(hex(encode(word)), 2 * i + 1, 2)) AS BIGINT))),
                         lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INT) + 1])), 4294967295) % 10000 AS bucket
  FROM n, crc_table),
hist AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM crc GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM hist) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM hist) + 10000)))) AS BIGINT) AS gain
  FROM hist),
total AS (SELECT doc_id, sum(gain) AS gain FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features,
         CASE WHEN len(words) = 0 THEN 0 ELSE CAST((gain - (((gain % len(words)) + len(words)) % len(words))) / len(words) AS BIGINT) END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(concat('0x', left(sha256(concat('2024:', doc_id)), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN total USING (doc_id)),
ranked AS (
  SELECT doc_id, n_features, weight, weight + noise AS score,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND r <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN r END AS rank
FROM ranked
"""
