"""Operator 13: near-duplicates by SimHash, compared at the anchors of a covering code.

A text's shingles are its runs of ``WORDS`` lower-cased words (A-Z only), repeats included; fewer words are one shingle.
A bit of its fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes.  Fingerprints that differ in
``THRESHOLD`` bits or fewer are linked, and a component is what links reach.

The anchors are the words of a perfect Hamming code over bits 1 to 63 (bit i is column i of its parity check), with bit 0 free: 2^58
anchors, and every fingerprint lies within a covering radius of 1 of one.  Two fingerprints that differ in t bits have one midway, within
half of t (rounded up) of both; that has an anchor within the radius.  So fingerprints that are sent to every anchor within the
radius plus half of the threshold meet their partners from both sides: 33 anchors each for a threshold of 2, where the
radius plus the whole threshold on both sides would take 683.  The anchors come from a table by syndrome.  An anchor's group holds no more than the
2,081 fingerprints that lie within two bits of it, whatever the data: equal fingerprints are one.

A group is compared by counting bits, row against row, and puts out only links that join something in its block of
groups; components come from large-star / small-star rounds.

A null text is an empty one; a text without words has fingerprint zero, linked like any other.  Repeated rows each get
a row.  Rows without an id take part, but a component's id is the smallest id in it (null if it has none).  Very long texts are hashed
``PIECE`` shingles at a time.  Other columns play no part; no rows give none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.graph import components, parted_anew
from tapeworks.llm.shared import cut, small_batches
from tapeworks.llm.words import replace_columns

WORDS, THRESHOLD, BITS, SEED = 3, 2, 64, 42
#: The covering radius of the anchors.
RADIUS = 1
#: Shingles whose bits are counted at once, and rows of anchors' groups that are compared at once (a group may add to that).
PIECE, BLOCK_ROWS = 100_000, 200_000


def hashes(text: str, words: int = WORDS):
    """XXH64 of each shingle of a text."""
    own = text.encode().lower().split()  # of bytes, both know ASCII alone
    if not own:
        return
    joined = b" ".join(own)
    ends = list(itertools.accumulate(len(w) + 1 for w in own))
    starts = [0, *ends]
    for a, b in zip(starts, ends[words - 1 :] or ends[-1:]):
        yield xxhash.xxh64_intdigest(joined[a : b - 1], SEED)


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """The fingerprints (uint64) of texts."""
    ones, n = np.zeros((len(texts), BITS), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held, of = [], []

    def count() -> None:
        h = np.array(held, dtype="<u8")
        at = np.flatnonzero(np.diff(of, prepend=-1))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        who = np.array(of)[at]
        ones[who] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        n[who] += np.diff(at, append=len(of))
        held.clear()
        of.clear()

    for i, t in enumerate(texts):
        own = hashes(t, words)
        while part := list(itertools.islice(own, PIECE)):
            held += part
            of += [i] * len(part)
            if len(held) >= PIECE:
                count()
    if held:
        count()
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def patterns(threshold: int = THRESHOLD) -> list[np.ndarray]:
    """For each syndrome, what to flip in a fingerprint to get the anchors within the radius and half of the threshold."""
    out: list[list[int]] = [[] for _ in range(BITS)]
    for size in range(RADIUS + (threshold + 1) // 2 + 1):
        for at in itertools.combinations(range(BITS), size):
            syndrome = 0
            for i in at:
                syndrome ^= i
            out[syndrome].append(sum(1 << i for i in at))
    return [np.array(x, dtype=np.uint64) for x in out]


def syndromes(x: np.ndarray) -> np.ndarray:
    """The sum (exclusive or) of the numbers of the bits that are set."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(BITS.bit_length() - 1):
        checked = np.uint64(sum(1 << i for i in range(BITS) if i >> k & 1))
        out |= (np.bitwise_count(x & checked).astype(np.int64) & 1) << k
    return out


def anchored(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(anchor, fp) for each fingerprint of prints (fp) and each of its anchors."""

    def run(batches):
        table = patterns(threshold)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            of = syndromes(fp)
            for s in np.unique(of):
                own = fp[of == s]
                to = own[:, None] ^ table[s][None, :]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (to.ravel(), np.repeat(own, len(table[s])))], ["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor long, fp long")


def joining_links(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one anchor (rows lie together by anchor) that join what no link before has joined."""
    ids, code = np.unique(fp, return_inverse=True)
    root = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    at, k = np.arange(len(fp)), 1
    while True:
        at = at[at + k < len(fp)]
        at = at[anchor[at + k] == anchor[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= threshold]
        a, b = code[near], code[near + k]
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
        if apart.any():
            while (root[root] != root).any():
                root = root[root]
        k += 1
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join all that are linked."""

    def run(batches):
        held: list[np.ndarray] = []

        def block(rows: np.ndarray):
            a, b = joining_links(rows[0], rows[1].view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("anchor", "fp")]))
            if sum(x.shape[1] for x in held) >= BLOCK_ROWS:
                rows = np.concatenate(held, axis=1)
                last = int(np.searchsorted(rows[0], rows[0, -1]))  # the last anchor's group may go on
                if last:
                    yield block(rows[:, :last])
                held = [rows[:, last:]]
        if held:
            yield block(np.concatenate(held, axis=1))

    return anchored(prints, threshold).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> list:
        return [pa.array(fingerprints([t or "" for t in batch.column("fp").to_pylist()]).view(np.int64))]

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("fp"))
    rows = cut(replace_columns(own, "fp", {"fp": "bigint"}, work))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = parted_anew(components(links(small_batches(prints), threshold)), "id").withColumnRenamed("id", "fp")
    of = cut(prints.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    least = parted_anew(of.groupBy("comp").agg(F.min("first").alias("component_id")), "comp")
    known = of.join(least, "comp").select("fp", "component_id")
    return rows.join(parted_anew(known, "fp"), "fp").select("doc_id", "fp", "component_id")


def op13_simhash_anchors(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
