"""Operator 12: what filters take from each other, in every order they can be applied in.

Each text is reduced to a mask of the filters it fails.  What becomes of a mask at each step of each order is known
beforehand: one wide integer holds, in fields of ``FIELD_BITS`` bits, the outcomes of all of them (120 orders of five
filters are 600 steps, ``OUTCOMES`` fields each).  The integers of a part's documents are added up, those of labelled
documents once more apart, and unpacked into a row for each step.  A field counts documents, of which there are fewer
than ``2 ** FIELD_BITS``, so no field runs over into the next.  Equal masks of a part and label are counted before they
are multiplied in, so that a part is a few hundred rows at most, however many documents it has.

Whether a text repeats one of a smaller id is decided by a digest (128 bits of SHA-256).  Copies in one part are brought
together before the smallest id is joined back to a digest, and that join may split a digest that stands in many rows.

A null text is an empty one; a null part is an empty string.  Rows without an id rank after all others: they repeat any
row that has one, and none repeats another without one.  Rows that share an id don't repeat each other.  An id with several labels
counts as good (toxic) if one of them says so.  No documents give no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut
from tapeworks.llm.words import replace_columns

FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
FIELD_BITS = 64
_SYMBOLS = b"#$%&*|"
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def fails(text: str) -> int:
    """The mask of the filters A to D that a text fails; bit i is filter i."""
    raw = text.encode()
    words = raw.split()  # bytes.split() parts at the six ASCII white spaces alone
    upper = int(_UPPER[np.frombuffer(raw, dtype=np.uint8)].sum())
    symbol = any(c in raw for c in _SYMBOLS)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * len(text)) << 2 | symbol << 3


def masks(docs: DataFrame, text: str) -> DataFrame:
    """docs with the text column replaced by its digest (binary), and ``mask``: the filters A to D that it fails."""

    def work(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        return [[hashlib.sha256(t.encode()).digest()[:16] for t in texts], [fails(t) for t in texts]]

    return replace_columns(docs, text, {text: "binary", "mask": "int"}, work)


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, bit of the step's filter, mask of the filters before it) of all steps of all orders."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for k, i in enumerate(order):
            out.append((name, k + 1, 1 << i, before))
            before |= 1 << i
    return out


def packed(mask: int, filters: str = FILTERS) -> int:
    """The wide integer of a mask: field ``len(OUTCOMES) * step + outcome`` is 1 if that is what happens to it there."""
    out = 0
    for at, (_, _, bit, before) in enumerate(steps(filters)):
        failed, gone = bool(mask & bit), bool(mask & before)
        for k, on in enumerate((not gone and not failed, failed and not gone, failed and gone, mask == bit)):
            out |= on << FIELD_BITS * (len(OUTCOMES) * at + k)
    return out


def unpacked(total: int, filters: str = FILTERS) -> np.ndarray:
    """The counts in a sum of packed integers, by step and outcome."""
    n = len(steps(filters)) * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(n * FIELD_BITS // 8, "little"), dtype="<u8").reshape(-1, len(OUTCOMES)).astype(np.int64)


def _summed(filters: str):
    """The steps' rows of one part, from its counts of masks by label."""
    plan = steps(filters)
    wide = {}

    def run(table: pa.Table) -> pa.Table:
        every = good = toxic = 0
        for mask, is_good, is_toxic, n in zip(*(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))):
            if mask not in wide:
                wide[mask] = packed(mask, filters)
            own = wide[mask] * n
            every += own
            good += own * is_good
            toxic += own * is_toxic
        counts = unpacked(every, filters)
        removed = OUTCOMES.index("removed")
        bits = np.array([x[2] for x in plan])
        shares = {b: int(counts[bits == b, removed].sum()) for b in set(bits.tolist())}
        out = {"part": [table.column("part")[0].as_py()] * len(plan), "filter_order": [x[0] for x in plan], "step": pa.array([x[1] for x in plan], pa.int32())}
        out |= {k: counts[:, i] for i, k in enumerate(OUTCOMES)}
        out |= {"good_lost": unpacked(good, filters)[:, removed], "toxic_lost": unpacked(toxic, filters)[:, removed], "shapley": [shares[x[2]] for x in plan]}
        return pa.table(out)

    return run


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what is kept, removed there, redundant, failing alone, and lost of the labelled.

    Filters are A: under 50 words; B: under 65 % of the words distinct; C: over 5 % capitals; D: a symbol of ``#$%&*|``;
    E: the text of a smaller id.  labels: (doc_id, quality, toxic).
    """
    own = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("key"))
    rows = cut(masks(own, "key").groupBy("key", "doc", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    rank = F.struct(F.col("doc").isNull().alias("none"), F.col("doc"))
    repeated = rows.groupBy("key").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = repeated.select(F.concat("key", F.lit(b"")).alias("key"), "first")  # a new key: the join shuffles both sides and can split a hot one
    is_1 = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(is_1("quality").alias("good"), is_1("toxic").alias("toxic"))
    said = said.where("good + toxic > 0").select((F.col("doc") + 0).alias("doc"), "good", "toxic")
    both = rows.join(said, "doc", "left").join(repeated, "key", "left")
    again = (F.col("first").isNotNull() & ~rank.eqNullSafe(F.col("first"))) & ~(F.col("doc").isNull() & F.col("first.doc").isNull())
    mask = F.col("mask") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = both.groupBy("part", mask.alias("mask"), flag("good"), flag("toxic")).agg(F.sum("n").alias("n"))
    numbers = ", ".join(f"{c} long" for c in (*OUTCOMES, "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInArrow(_summed(FILTERS), f"part string, filter_order string, step int, {numbers}")


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs.select("doc_id", "text", "source"), labels)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         map {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
              'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS m
  FROM w LEFT JOIN l USING (doc_id)),
g AS (
  SELECT part, m, good, toxic, count(*) AS n, len(list_filter(map_values(m), lambda x: x)) AS n_failed FROM f GROUP BY part, m, good, toxic),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, string_split(left(filter_order, step - 1), '') AS before
      FROM o, range(1, 6) r(step)),
p AS (
  SELECT part, filter_order, step, own, n, good, toxic, n_failed, m[own] AS failed,
         step > 1 AND len(list_filter(before, lambda b: m[b])) > 0 AS gone
  FROM g, s),
q AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (failed AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (failed AND n_failed = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n * good) FILTER (failed AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n * toxic) FILTER (failed AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM p GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM q
"""
