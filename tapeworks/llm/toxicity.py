"""Operator 9: toxicity by class-conditional Kneser-Ney models over characters.

Two interpolated Kneser-Ney models of order 4, over the bytes of the lower-cased text, are learnt from toxic and from
ordinary documents; their lowest order is one distribution that both share, so an expression that is rare in either
class falls back to the same counts.  The difference of their log-likelihoods, normalised by length in two ways, goes
through a logistic curve that documents set aside from the counts have fitted.

The alphabet is the most frequent bytes of the sample and one symbol for the rest, so that the difference of both
models is one dense table of a fixed size, and a text costs one lookup for each byte.  ``MAX_DOCS`` labelled documents
of each class at most (those with the smallest hashes) are learnt from.  Their n-grams are counted by ``PARTS`` tasks, a
slice of text at a time; one task adds the counts, and the driver sees five features of each document set aside.

Null and empty texts have a likelihood ratio of 0 and so the score that the classes' shares give.  Rows without an id
or a label teach nothing; a repeated id is toxic if one of its labels is, and teaches by the least of its texts.  Very long texts
are counted like others, a text at a time.  Without labels of both classes the score
is the toxic share (half a document of each class is added to it).  Repeated documents get the same score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, drop_cut, small_batches
from tapeworks.llm.words import _LOWER, _SPACE, append_columns, slices

#: Labelled documents of each class that are learnt from at most.
MAX_DOCS = 4000
#: Tasks that count the n-grams of the learnt documents.
PARTS = 8
SYMBOLS, ORDER = 40, 4
#: From which log-likelihood ratio a word counts as an expression of its own; features of a text.
STRONG, FEATURES = 4.5, 5
#: One in so many of them is set aside for the logistic curve.
ASIDE = 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def codes(texts: pa.Array, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram number at each byte of the texts, and where each text's begin; a text starts after blanks.

    White space is one symbol, number 0.
    """
    raw = [b"   " + (t or "").encode() for t in texts.to_pylist()]
    edge = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    s = symbol[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int32)
    out = s.copy()
    for i in range(1, ORDER):
        out[i:] += s[:-i] * np.int32(SYMBOLS**i)
    keep = np.ones(len(s), dtype=bool)
    for i in range(ORDER - 1):
        keep[edge[:-1] + i] = False
    return out[keep], edge - np.arange(len(edge)) * (ORDER - 1)


def alphabet(counts: np.ndarray) -> np.ndarray:
    """Symbol of each byte: 0 for white space, the most frequent others, and the last for the rest."""
    counts = counts.copy()
    counts[_SPACE] = 0
    out = np.full(256, SYMBOLS - 1, dtype=np.uint8)
    folded = np.bincount(_LOWER, counts, 256)
    for i, b in enumerate(np.argsort(-folded, kind="stable")[: SYMBOLS - 2]):
        out[b] = i + 1
    out = out[_LOWER]
    out[_SPACE] = 0
    return out


def kneser_ney(counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """log p(last | before) for each n-gram of the counts' order, interpolated down to the shared distribution."""
    levels = [counts.reshape([SYMBOLS] * ORDER).astype(np.float64)]
    for _ in range(ORDER - 2):
        levels.append((levels[-1] > 0).sum(axis=0).astype(np.float64))
    p = shared
    for n in reversed(levels):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        total = n.sum(axis=-1, keepdims=True)
        kinds = (n > 0).sum(axis=-1, keepdims=True)
        own = (np.maximum(n - d, 0) + d * kinds * p[None]) / np.maximum(total, 1)
        p = np.where(total > 0, own, np.broadcast_to(p[None], n.shape))
    return np.log(p).astype(np.float32).ravel()


@dataclass
class Model:
    symbol: np.ndarray
    ratio: np.ndarray  # log p(toxic) - log p(ordinary) of each 4-gram
    weights: np.ndarray  # of the constant and of the features
    sent: Broadcast | None = None  # symbol and ratio (compressed), of fixed size, as tasks get them

    def features(self, texts: pa.Array) -> np.ndarray:
        """1, the ratio over the length, and the ratio over the length's square root, for each text."""
        code, edge = codes(texts, self.symbol)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[code], dtype=np.float64)])
        n = np.maximum(np.diff(edge), 1)
        llr = total[edge[1:]] - total[edge[:-1]]
        blank = code % SYMBOLS == 0
        blank[edge[1:][edge[1:] > 0] - 1] = True  # a word ends with its text
        ends = np.flatnonzero(blank)
        word = np.diff(total[ends + 1], prepend=0.0)
        strong = np.concatenate([[0.0], np.cumsum(np.maximum(word - STRONG, 0))])
        at = np.searchsorted(ends, edge)
        peak = strong[at[1:]] - strong[at[:-1]]
        return np.stack([np.ones(len(n)), 20 * llr / n, llr / np.sqrt(n), np.minimum(peak, 50) / 10, 20 * peak / n], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps; the ridge keeps classes that are parted completely finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def ratios(gram: np.ndarray) -> np.ndarray:
    """The difference of both classes' models from their 4-gram counts; nothing where a class has none."""
    if not gram[0].any() or not gram[1].any():
        return np.zeros(SYMBOLS**ORDER, dtype=np.float32)
    both = (gram[0] + gram[1]).reshape(-1, SYMBOLS).sum(axis=0) + 1.0
    shared = both / both.sum()
    return kneser_ney(gram[1], shared) - kneser_ney(gram[0], shared)


def _byte_counts(batches):
    counts = np.zeros(256, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            counts += np.bincount(np.frombuffer("".join(t or "" for t in part.column("text").to_pylist()).encode(), dtype=np.uint8), minlength=256)
    yield pa.RecordBatch.from_pydict({"n": [counts.tobytes()]})


def _gram_counts(symbol: np.ndarray):
    """Rows (toxic, grams, n): the 4-grams of a class in a task, and how often each occurs."""

    def run(batches):
        gram = np.zeros((2, SYMBOLS**ORDER), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                toxic = part.column("toxic").to_numpy()
                for c in (0, 1):
                    own = part.column("text").filter(pa.array(toxic == c))
                    if len(own):
                        gram[c] += np.bincount(codes(own, symbol)[0], minlength=SYMBOLS**ORDER)
        at = [np.flatnonzero(g) for g in gram]
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([0, 1], pa.int32()), "grams": [x.astype(np.int32).tobytes() for x in at], "n": [g[x].tobytes() for g, x in zip(gram, at)]})

    return run


def _add_counts(batches):
    """The ratio table from the counts of all tasks, PARTS rows of bounded size for each class."""
    gram = np.zeros((2, SYMBOLS**ORDER), dtype=np.int64)
    for batch in batches:
        for toxic, at, n in zip(*(batch.column(c).to_pylist() for c in ("toxic", "grams", "n"))):
            gram[toxic, np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
    yield pa.RecordBatch.from_pydict({"ratio": [zstandard.compress(ratios(gram).tobytes())]})


def _ratio(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.float32)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """The model from the labelled documents outside the held-out ones."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    prior = float(np.log(share / (1 - share)))
    order = F.xxhash64("doc_id")
    picked = [own.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(max_docs) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # max_docs rows of each class at most
    sample = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = sample.select("text", "toxic", (F.crc32(F.concat(F.lit("aside"), F.col("doc_id").cast("string")).cast("binary")) % ASIDE == 0).alias("aside"))
    sample = cut(small_batches(sample).repartition(PARTS))
    symbol = alphabet(sum((np.frombuffer(r.n, np.int64) for r in sample.select("text").mapInArrow(_byte_counts, "n binary").collect()), np.zeros(256, dtype=np.int64)))
    counts = sample.where("not aside").select("text", "toxic").mapInArrow(_gram_counts(symbol), "toxic int, grams binary, n binary")
    got = counts.repartition(1).mapInArrow(_add_counts, "ratio binary").collect()
    packed = got[0].ratio if got else zstandard.compress(bytes(4 * SYMBOLS**ORDER))
    sent = docs.sparkSession.sparkContext.broadcast((symbol, bytes(packed)))
    model = Model(symbol, _ratio(packed), np.eye(FEATURES)[0] * prior, sent)
    tests = {r.toxic for r in sample.where("aside").select("toxic").distinct().collect()}

    def features(batches):
        m = Model(sent.value[0], _ratio(sent.value[1]), np.zeros(FEATURES))
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(m.features(part.column("text"))), pa.list_(pa.float64()))], ["toxic", "x"])

    some = sample.where("aside") if len(tests) == 2 else sample
    rows = some.select("text", "toxic").mapInArrow(features, "toxic int, x array<double>").collect() if model.ratio.any() else []
    drop_cut(sample)
    if rows:
        rows.sort(key=lambda r: (r.toxic, r.x))  # the sums don't depend on which task came first
        y = np.array([r.toxic for r in rows], dtype=float)
        model.weights = logistic(np.array([r.x for r in rows]), y)
        model.weights[0] += prior - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score`` (double, 0 to 1) and ``predicted`` (int); columns of docs with these names are replaced."""
    sent, weights = model.sent, model.weights

    def setup() -> Model:
        symbol, packed = sent.value
        return Model(symbol, _ratio(packed), weights)

    def work(texts: pa.Array, own: Model) -> list:
        got = own.score(texts)
        return [pa.array(got), pa.array((got >= 0.5).astype(np.int32))]

    return append_columns(docs, text, {"score": "double", "predicted": "int"}, work, setup)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
