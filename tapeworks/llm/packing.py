"""Operator 4: packing of token sequences by non-negative least squares.

Every document's ids (and an end id) fill whole windows first; what remains, its tail, is shorter than a window.
Tails are counted by bins of ``WIDTH`` ids.  Shallow combinations, up to ``DEPTH`` bins whose upper ends add up to the
window, are enumerated over the bins that have tails; projected gradient steps solve for how often each is used against
the histogram, the counts are rounded down, then up where tails are left, and what no combination takes is solved for
again.  So most tails are placed whole; a sequence has room for less than ``WIDTH`` ids for each of them.  The residual
tails are packed greedily: they fill the rooms one after the other, and then sequences of their own, and are cut only
where a room ends.  If they are fewer than the rooms, some planned sequences are given up, so that only the very last
sequence can hold padding.

The histogram has at most ``window`` rows whatever the input, and the plan's size depends on the window alone; these are
all that the driver sees, and all that is broadcast.  Ranks and running totals are computed in two levels (within
salted groups, then over the groups' totals), so that neither a common length nor the order of all rows meets in one task.

A null text is an empty one: only its end id is packed.  Repeated rows are packed each for itself.  An empty table
gives no pieces.  A very long text is encoded by itself; its whole windows leave as checksums.  Columns other than
``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.shared import cut
from tapeworks.llm.words import append_columns, finder, per_worker, split_words

WINDOW = 4096
END_ID = 2
#: Ids in a bin of tail lengths, and the most tails in a combination.
WIDTH, DEPTH = 64, 6
#: Groups that rows of one tail length are dealt to.
SALTS = 256
#: Rows that one group of a running total holds, about, and the least number of groups.
RUN_ROWS, RUN_GROUPS = 50_000, 1000
#: Words whose ids a task keeps; it starts anew beyond it.
CACHE_WORDS = 1_200_000


class WordIds:
    """ids of white-space separated words, for a tokenizer file that drops white space, and so encodes each word by itself.

    Words are known by their 64-bit hash in a sorted array; only words not met before reach the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = finder(split)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of ASCII words without special tokens, and how many each has: their distinct pieces are encoded in one text."""
        pieces = [self.find(w.lower()) for w in words]
        code: dict[str, int] = {}
        of = np.array([code.setdefault(p, len(code)) for x in pieces for p in x], dtype=np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(code)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(code):
            return self._each(words)
        start = np.concatenate([[0], end])[:-1].astype(np.int64)
        n = (end - start)[of]
        edge = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(start[of] - edge[:-1], n) + np.arange(edge[-1])]
        return flat, np.diff(edge[np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)])

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words, each encoded as a text, and how many each has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        plain = np.array([w.isascii() and not any(t in w for t in self.special) for w in words])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        parts = [f([words[i] for i in on]) for f, on in ((self._plain, np.flatnonzero(plain)), (self._each, np.flatnonzero(~plain))) if len(on)]
        n = np.concatenate([self.n, *(x[1] for x in parts)])
        known = np.concatenate([self.known, hashes[order]])
        start = len(self.flat) + np.concatenate([[0], np.cumsum(n[len(self.n) :])])[:-1]
        by_hash = np.argsort(known, kind="stable")
        self.at, self.n, self.known = np.concatenate([self.at, start])[by_hash], n[by_hash], known[by_hash]
        self.flat = np.concatenate([self.flat, *(x[0] for x in parts)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and where each text's begin."""
        w = split_words(texts, lower=False)
        unique, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = self.known[place] != unique if len(self.known) else np.ones(len(unique), dtype=bool)
        if new.any():
            raw = w.data.tobytes()
            self.learn(unique[new], [raw[w.start[i] : w.end[i]].decode() for i in first[new]])
            place = np.searchsorted(self.known, unique)
        n = self.n[place][inverse] if len(unique) else np.zeros(0, np.int64)
        at = self.at[place][inverse] if len(unique) else n
        edge = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at - edge[:-1], n) + np.arange(edge[-1])] if edge[-1] else np.zeros(0, np.uint32)
        return ids, edge[w.first]


def token_windows(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """docs without its text, with the checksums of its whole windows and of its tail, and the tail's ids.

    n_ids: ids with the end id; full: crc32 of each whole window; tail_n, tail_crc, tail: what is left (ids as
    little-endian uint32, deflated).
    """
    fields = {"n_ids": "bigint", "full": "array<bigint>", "tail_n": "int", "tail_crc": "bigint", "tail": "binary"}

    def work(texts: pa.Array, words: WordIds) -> list:
        ids, edge = words.encode(texts)
        raw, out = ids.astype("<u4").tobytes(), []
        end = np.uint32(end_id).astype("<u4").tobytes()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = raw[4 * a : 4 * b] + end
            n = b - a + 1
            whole = n // window * window
            tail = own[4 * whole :]
            out.append((n, [zlib.crc32(own[4 * i : 4 * (i + window)]) for i in range(0, whole, window)], n - whole, zlib.crc32(tail), zlib.compress(tail, 1)))
        return [[x[i] for x in out] for i in range(5)]

    return append_columns(docs, "text", fields, work, lambda: per_worker(WordIds, path)).drop("text")


def combinations(whole: int, depth: int, bins: list[int]) -> np.ndarray:
    """Rows of at most depth of the bins (descending, then zeros) that add up to whole."""
    out: list[tuple[int, ...]] = []
    bins = sorted(bins, reverse=True)

    def add(chosen: tuple[int, ...], at: int, left: int) -> None:
        if not left:
            out.append(chosen + (0,) * (depth - len(chosen)))
        elif len(chosen) < depth:
            for i in range(at, len(bins)):
                if bins[i] * (depth - len(chosen)) < left:
                    break
                if bins[i] <= left:
                    add((*chosen, bins[i]), i, left - bins[i])

    add((), 0, whole)
    return np.array(out, dtype=np.int64).reshape(-1, depth)


def solve(combos: np.ndarray, have: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that brings sum of x over the combinations' bins near the histogram: accelerated projected gradient.

    Rows are scaled by the square root of the histogram, columns by their norm.
    """
    weight = np.where(have > 0, 1 / np.sqrt(np.maximum(have, 1.0)), 0.0)
    weight[0] = 0
    norm = np.sqrt(sum(weight[c] ** 2 * (combos == c[:, None]).sum(axis=1) for c in combos.T))  # a bin that comes twice counts twice
    target = have * weight

    def forward(y):
        return np.bincount(combos.T.ravel(), np.tile(y / norm, combos.shape[1]), len(have)) * weight

    def back(r):
        return (r * weight)[combos].sum(axis=1) / norm

    v = np.random.default_rng(0).random(len(combos))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(forward(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1 / max(1.05 * np.linalg.norm(back(forward(v))), 1e-300)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(forward(y) - target), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / norm


def _times(have: np.ndarray, whole: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations, and how often each is used: solved, rounded, and solved again for what is left."""
    left = have.copy()
    combos = combinations(whole, depth, np.flatnonzero(have).tolist())
    times = np.zeros(len(combos), dtype=np.int64)
    if not len(combos):
        return combos, times
    need = np.stack([np.bincount(c[c > 0], minlength=len(have)) for c in combos])
    while True:
        on = np.flatnonzero((need <= left).all(axis=1))
        if not len(on):
            return combos, times
        x, before = solve(combos[on], left.astype(float)), times.sum()
        for i, n in [*((i, int(v)) for i, v in zip(on, x)), *((on[j], 1) for j in np.argsort(np.floor(x) - x, kind="stable"))]:
            n = min(n, int((left[need[i] > 0] // need[i][need[i] > 0]).min())) if n else 0
            if n > 0:
                times[i] += n
                left -= n * need[i]
        if times.sum() == before:
            return combos, times


def plan(histogram: dict[int, int], window: int = WINDOW, depth: int = DEPTH) -> tuple[list[tuple], int]:
    """Rows (length, rank from, rank to, first sequence, tails of the row in a sequence, slot, number before) and the sequences."""
    width = max(1, min(WIDTH, window // 64))
    whole = window // width
    have = np.zeros(whole + 1, dtype=np.int64)
    for n, c in histogram.items():
        have[-(-n // width)] += c
    combos, times = _times(have, whole, depth)
    total = sum(n * c for n, c in histogram.items())
    drawn = [(i, int(times[i])) for i in np.argsort(-times, kind="stable") if times[i]]
    while True:
        rows, sequences, tokens = _draw(histogram, combos, drawn, width)
        spare = (sequences * window - tokens) - (total - tokens)  # rooms without residual ids
        if spare <= 0 or not drawn:
            return rows, sequences
        give_up = -(-spare // window)
        while give_up > 0 and drawn:
            i, n = drawn.pop()
            if n > give_up:
                drawn.append((i, n - give_up))
            give_up -= n


def _draw(histogram: dict[int, int], combos: np.ndarray, drawn: list[tuple[int, int]], width: int) -> tuple[list[tuple], int, int]:
    """Rows of a plan that takes each bin's tails in order of length and rank; its sequences, and the ids placed."""
    queue: dict[int, list[list[int]]] = {}
    for n in sorted(histogram):
        queue.setdefault(-(-n // width), []).append([n, 0, histogram[n]])
    rows, sequences, tokens = [], 0, 0
    for i, m in drawn:
        slot = 0
        for b in sorted({x for x in combos[i].tolist() if x}, reverse=True):
            k = int((combos[i] == b).sum())
            done = 0
            while done < m * k:
                n, at, end = head = queue[b][0]
                take = min(end - at, m * k - done)
                rows.append((n, at, at + take, sequences, k, slot, done))
                head[1] += take
                done += take
                tokens += n * take
                if head[1] == end:
                    queue[b].pop(0)
            slot += k
        sequences += m
    return rows, sequences, tokens


def running_total(df: DataFrame, value: str, row: str, name: str, groups: int) -> DataFrame:
    """df with the sum of value over the rows before, in an order of its own: groups by hash, then row."""
    df = df.withColumn("_group", F.pmod(F.xxhash64(row), F.lit(groups)))
    totals = df.groupBy("_group").agg(F.sum(value).alias("_total"))
    before = totals.select("_group", (F.sum("_total").over(Window.orderBy("_group")) - F.col("_total")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_group").orderBy(row).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(own, F.lit(0))).join(before, "_group").withColumn(name, F.col(name) + F.col("_before")).drop("_group", "_before")


def ranked(df: DataFrame, key: str, row: str, name: str) -> DataFrame:
    """df with each row's rank (from 0) among those with its key, which is one of few integers."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    counts = df.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_salt", (F.sum("_n").over(Window.partitionBy(key).orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(row)) - 1
    return df.withColumn(name, own).join(before, [key, "_salt"]).withColumn(name, F.col(name) + F.col("_before")).drop("_salt", "_before")


@F.pandas_udf(T.LongType())
def _crc_of(tail: pd.Series, start: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(zlib.decompress(t)[4 * a : 4 * (a + k)]) for t, a, k in zip(tail, start, n)], dtype="int64")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = token_windows(docs.select("doc_id", "text"), path, window, end_id).withColumn("row", F.monotonically_increasing_id())
    tokens = cut(tokens)
    light = tokens.select("row", "doc_id", "n_ids", "tail_n", "tail_crc")
    histogram = {r.tail_n: r.n for r in tokens.where("tail_n > 0").groupBy("tail_n").agg(F.count("*").alias("n")).collect()}  # a row for each length
    rows, sequences = plan(histogram, window)
    groups = max(RUN_GROUPS, sum(histogram.values()) // RUN_ROWS)
    schema = T._parse_datatype_string("tail_n int, rank_from long, rank_to long, first long, each long, slot long, before long")
    slots = F.broadcast(spark.createDataFrame(rows, schema))  # its size depends on the window alone
    tails = ranked(light.where("tail_n > 0"), "tail_n", "row", "rank")
    placed = tails.join(slots, (tails.tail_n == slots.tail_n) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")), "left").drop(slots.tail_n)
    j = F.col("before") + F.col("rank") - F.col("rank_from")
    placed = cut(placed.select(*light.columns, (F.col("first") + F.floor(j / F.col("each"))).alias("seq"), (F.col("slot") + j % F.col("each")).alias("slot")))
    start = (F.col("n_ids") - F.col("tail_n")).cast("long")
    common = lambda s, n, crc, seq, at: [
        "doc_id", s.cast("long").alias("start"), n.cast("long").alias("length"), crc.cast("long").alias("ids_crc32"),
        F.col("n_ids").alias("doc_tokens"), seq.cast("long").alias("sequence_id"), at.cast("long").alias("offset"),
    ]
    before = F.coalesce(F.sum("tail_n").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitted = placed.where("seq is not null").withColumn("at", before).select(*common(start, F.col("tail_n"), F.col("tail_crc"), F.col("seq"), F.col("at")))
    # rooms of the planned sequences, then sequences of residual tails alone, as one line that the residual tails are laid along
    filled = placed.where("seq is not null").groupBy("seq").agg(F.sum("tail_n").alias("filled"))
    rooms = running_total(filled.select("seq", "filled", (window - F.col("filled")).alias("room")).where("room > 0"), "room", "seq", "from", groups)
    in_plan = sum(n * (to - at) for n, at, to, *_ in rows)
    free, left = sequences * window - in_plan, sum(n * c for n, c in histogram.items()) - in_plan
    own = max(0, -(-(left - free) // window))
    more = spark.range(own).select((sequences + F.col("id")).alias("seq"), F.lit(0).cast("long").alias("filled"), F.lit(window).cast("long").alias("room"), (free + F.col("id") * window).alias("from"))
    rooms = rooms.select("seq", F.col("filled").cast("long"), F.col("room").cast("long"), F.col("from").cast("long")).unionByName(more)
    rest = running_total(placed.where("seq is null").select(*light.columns), "tail_n", "row", "at", groups)
    cells = lambda at, n: F.explode(F.sequence(F.floor(F.col(at) / window), F.floor((F.col(at) + F.col(n) - 1) / window)))
    rooms, laid = rooms.withColumn("cell", cells("from", "room")), rest.withColumn("cell", cells("at", "tail_n"))
    begin, end = F.greatest("at", "from"), F.least(F.col("at") + F.col("tail_n"), F.col("from") + F.col("room"))
    parts = laid.join(rooms, (laid["cell"] == rooms["cell"]) & (begin < end) & (F.floor(begin / window) == laid["cell"])).drop("cell")
    parts = parts.withColumns({"skip": begin - F.col("at"), "n": end - begin, "to": F.col("filled") + begin - F.col("from")})
    parts = parts.join(tokens.select("row", "tail"), "row").select(*common(start + F.col("skip"), F.col("n"), _crc_of("tail", "skip", "n"), F.col("seq"), F.col("to")))
    long = running_total(tokens.where(F.size("full") > 0).select("row", "doc_id", "n_ids", "full", F.size("full").alias("n_full")), "n_full", "row", "at", groups)
    base = sequences + own
    full = long.select("doc_id", "n_ids", "at", F.posexplode("full").alias("i", "crc")).select(*common(F.col("i") * window, F.lit(window), F.col("crc"), base + F.col("at") + F.col("i"), F.lit(0)))
    return fitted.unionByName(parts).unionByName(full)


def op4_packing(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path)
