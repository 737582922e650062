"""Operator 1: exact top-k search with pivot-table elimination.

Every vector becomes integers, floor(scale * x), and the score is their inner product.  Candidates keep a table of
their Euclidean distances to a fixed number of pivots.  For a query q and a candidate x the largest
|d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), and so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the score.  Candidates of a batch are evaluated in the order of
their bounds until the next bound is below the k-th best score so far; a first k-th best comes from the pivots' sample.

Queries are written once as a table of blocks, told apart by a hash, of ``BLOCK_BYTES`` or so each (a size that doesn't
grow with the data).  Each block is broadcast in turn and goes over all candidates once, without a shuffle of them,
gives k rows for each query and partition at most, and the best k of these are written beside those of the other
blocks.  The driver holds a block at a time.  Pairs of blocks of queries and candidates in shuffled tasks would move
all candidates once for each block of queries instead of reading them.

Vectors that are null, empty, or hold null or non-finite components take no part, as neither do rows without an id;
a vector of another length than a query's isn't its candidate.  Equal scores go to the smaller id; repeated ids are
candidates each for itself, but a query never finds its own id.  Different vectors of one query id share one ranking: a
candidate's score is the best that any of them gives it.  Sums of products must stay below 2**63.  An empty table gives
no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.shared import drop_at_end, use_shared_folder

SCALE, K, PIVOTS, SAMPLE = 1024, 10, 24, 512
#: Bytes of the queries that are searched for at once.
BLOCK_BYTES = 8_000_000
#: Candidates of a batch that are evaluated before the bound is looked at again.
STEP = 64
_EXACT, _NONE = 2**53, -(2**63 - 1)


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of long): the vectors that take part."""
    own = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & sound)
    return own.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))


class Search:
    """The queries of a block, and the best k of each so far (score, -id)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.norm = (v.astype(np.float64) ** 2).sum(1)
        self.to = _distances(v, pivots)
        self.pivots, self.floor = pivots, floor
        self.score = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), -1)

    def look(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Holds a batch of candidates against every query."""
        norm, table = (v.astype(np.float64) ** 2).sum(1), _distances(v, self.pivots)
        for i, q in enumerate(self.ids):
            bound = np.abs(table - self.to[i]).max(axis=1)
            upper = (self.norm[i] + norm - bound * bound) / 2
            upper += 1e-6 * (self.norm[i] + norm) + 1  # for what rounding takes from the distances
            least = max(self.score[i, -1], self.floor[i])
            keep = np.flatnonzero((upper >= least) & (ids != q))
            keep = keep[np.argsort(-upper[keep], kind="stable")]
            at, step = 0, STEP
            while at < len(keep) and upper[keep[at]] >= max(self.score[i, -1], self.floor[i]):
                part = keep[at : at + step]
                self.take(i, _product(v[part], self.v[i : i + 1])[:, 0], ids[part])
                at, step = at + step, 2 * step

    def take(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[i], score]), np.concatenate([self.found[i], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score[i], self.found[i] = score[best], ids[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = self.score > _NONE
        return np.repeat(self.ids, have.sum(1)), self.found[have], self.score[have]


def first_floor(q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """k-th best score of each query among the sample, which the k-th best of all can't be below."""
    out = np.full(len(q), _NONE)
    for a in range(0, len(q), 256):
        score = _product(q[a : a + 256], s)
        score[q_ids[a : a + 256, None] == s_ids] = _NONE
        if score.shape[1] >= k:
            out[a : a + 256] = np.partition(score, -k, axis=1)[:, -k]
    return out


def _pivots(v: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample, each farthest from those before."""
    at, far = [0], _distances(v, v[:1])[:, 0]
    while len(at) < min(n, len(v)):
        at.append(int(far.argmax()))
        far = np.minimum(far, _distances(v, v[at[-1:]])[:, 0])
    return v[at]


def _best(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of each query, a candidate once with the best of its scores."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rows.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, v) that is_query holds for, against all rows."""
    spark = vectors.sparkSession
    schema = T._parse_datatype_string("query_id long, vec_id long, score long")
    folder = f"{use_shared_folder(spark)}/top-{uuid.uuid4().hex}"
    drop_at_end(spark, folder)
    written = 0
    for dim, n in sorted((r.dim, r.n) for r in vectors.where(is_query).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        own = vectors.where(F.size("v") == dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # of a fixed number
        s_ids, s = np.array([r.vec_id for r in sample]), np.array([r.v for r in sample], dtype=np.int64)
        first, once = np.unique(s_ids, return_index=True)  # a repeated id counts once for the floor
        table = _pivots(s, pivots)
        blocks = -(-n * 8 * dim // block_bytes)
        queries = own.where(is_query).dropDuplicates().withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
        queries.repartition("block").write.partitionBy("block").parquet(f"{folder}/queries/dim={dim}")
        queries = spark.read.schema("vec_id long, v array<bigint>, block long").parquet(f"{folder}/queries/dim={dim}")
        for block in range(blocks):
            held = queries.where(F.col("block") == block).toPandas()  # a block: one partition of the table
            if held.empty:
                continue
            ids, v = held["vec_id"].to_numpy(), np.stack(held["v"].to_list()).astype(np.int64)
            sent = spark.sparkContext.broadcast((ids, v, table, first_floor(ids, v, first, s[once], k), k))

            def run(batches, sent=sent):
                search = Search(*sent.value)
                for batch in batches:
                    if batch.num_rows:
                        search.look(batch.column(0).to_numpy(), _matrix(batch.column(1)))
                q, x, score = search.rows()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(score)], ["query_id", "vec_id", "score"])

            _best(own.select("vec_id", "v").mapInArrow(run, schema), k).write.parquet(f"{folder}/found/pass={written}")
            sent.destroy()
            written += 1
    if not written:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(f"{folder}/found").drop("pass")
    return found if written == 1 else _best(found, k)  # an id's vectors may lie in several blocks


def op1_pivot_topk(embeddings: DataFrame) -> DataFrame:
    vectors = whole_vectors(embeddings, "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
