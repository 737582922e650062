"""Operator 6: substring dedup by hashing lines and passages.

Units are of two kinds.  Lines of ``LINE_WORDS`` words or more are units as they stand.  As passages also repeat within
lines, each text is parted after sentences and at words that winnowing chooses (the least hash of each ``WINDOW`` words, the
last of equal ones; about two in WINDOW + 1), the same wherever a passage stands, and from every part on the run of parts
with ``PASSAGE_WORDS`` words or more is a unit.  So every shared stretch of PASSAGE_WORDS + 2 * WINDOW - 1 words holds a
shared unit for certain, however its lines are broken.  The same runs are also made with parts that end with lines, for
shorter passages that are lines of their own.  A passage's words before its first unit and after its last one stay:
fewer than WINDOW before, fewer than 2 * WINDOW after.  Words are lower-cased and white space doesn't count, so units are normalised before they are hashed.

Digests (96 bits) are grouped globally; the occurrence that ranks earliest (by id, then position) is kept and the others
are removed.  Within a block of documents only the first occurrence of a digest leaves for the global grouping: later
ones are known to be repeats.  A task also remembers the digests that a block has held ``OFTEN`` times or that the block
before held as well, and lets go of a later block's occurrence only if it ranks before; so a line that stands in a third of all
documents, or in a few of each block, arrives about once or twice for each task.

Removed spans are given as code points of the original text, merged where they touch or overlap; the text that stays
keeps everything else.  Null texts are empty.  A document whose id is null ranks last.  Texts without an id, and those of
an id that several rows have, are told apart and ranked by a digest of 128 bits, so rows with the same id and text are one document,
which is cut alike in each of them.  Very long texts are blocks of their own; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import free_name, small_batches
from tapeworks.llm.words import gather, mix, replace_columns, split_words

LINE_WORDS, WINDOW, PASSAGE_WORDS = 8, 11, 20
#: Text of a block of documents within which repeats are told apart at once.
BLOCK_BYTES = 2_000_000
#: Occurrences in a block from which a task remembers a digest, and how many digests it remembers.
OFTEN, REMEMBERED = 4, 150_000
_KNOWN = -(2**63)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_BASE1, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _power(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def _run_hash(h: np.ndarray, first: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of h[first:end] for each pair, by sums over powers of the base and its inverse."""
    inverse = np.uint64(pow(int(base), -1, 2**64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(base, len(h)))])
    return mix((total[end] - total[first]) * _power(inverse, len(h) + 1)[first] + (end - first).astype(np.uint64))


def _chosen(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a word has the least hash of some WINDOW words of its text, the last of equal ones."""
    out = np.zeros(len(h), dtype=bool)
    m = len(h) - WINDOW + 1
    if m > 0:
        least, at = h[:m].copy(), np.arange(m)
        for i in range(1, WINDOW):
            on = np.flatnonzero(h[i : i + m] <= least)
            least[on] = h[i + on]
            at[on] = i + on
        out[at[text[:m] == text[WINDOW - 1 :]]] = True
    return out


def _runs(new_part: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and the word after the last, of the run of parts from each part that has enough words, all of one text."""
    part_first = np.flatnonzero(new_part)
    part_end = np.append(part_first[1:], len(text))
    j = np.searchsorted(part_end, part_first + PASSAGE_WORDS)
    fits = j < len(part_end)
    first, end = part_first[fits], part_end[j[fits]]
    same = text[first] == text[end - 1]
    return first[same], end[same]


def units(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """For each unit: index of its text, first byte and the byte after its last, and two hashes; in order of place."""
    w = split_words(texts)
    n = len(w.hash)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    lines = np.cumsum(np.concatenate([[0], (w.data == 10).astype(np.int64)]))
    new_line = np.ones(n, dtype=bool)  # the word starts a line
    new_line[1:] = (lines[w.start[1:]] != lines[w.end[:-1]]) | (w.text[1:] != w.text[:-1])
    new_part = _chosen(w.hash, w.text)  # wherever the passage stands
    new_part[0] = True
    new_part[1:] |= (w.text[1:] != w.text[:-1]) | _ENDS[w.data[w.end[:-1] - 1]]
    line_first = np.flatnonzero(new_line)
    line_end = np.append(line_first[1:], n)
    long = line_end - line_first >= LINE_WORDS
    both = [_runs(new_part, w.text), _runs(new_part | new_line, w.text)]
    run = np.unique(np.concatenate([a * (n + 1) + b for a, b in both]))
    run_first, run_end = run // (n + 1), run % (n + 1)
    first = np.concatenate([line_first[long], run_first])
    end = np.concatenate([line_end[long], run_end])
    kind = np.repeat(np.array([1, 2], dtype=np.uint64), [long.sum(), len(run_first)])
    order = np.argsort(first, kind="stable")
    first, end, kind = first[order], end[order], kind[order]
    h1 = mix(_run_hash(w.hash, first, end, _BASE1) ^ kind)
    h2 = mix(_run_hash(mix(w.hash), first, end, _BASE2) ^ kind)
    text = w.text[first]
    at = w.text_start[text]
    return text, w.start[first] - at, w.end[end - 1] - at, h1.view(np.int64), h2.view(np.int64)


def _ties(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each digest, in the order of the digests; 0 for those that are empty."""
    both = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _first_in_block(batches, tied: bool):
    """Rows (tie if tied, doc, h1, h2, span) from rows (doc, tie, t): h2 holds 32 bits of the second hash, span holds at, then to.

    span is negative if an occurrence of the digest is known that ranks before; such a row's digest is made up, as it
    needs no more grouping and all rows of a common digest would meet.  Four numbers keep the shuffled rows small.
    """
    earliest: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    before = np.zeros(0, dtype=np.int64)  # first hashes of the block before
    for block in gather(batches, "t", BLOCK_BYTES):
        ids, (tie1, tie2) = block.column("doc").to_numpy(), _ties(block.column("tie"))
        rank = np.lexsort((tie2, tie1, ids))
        ids, tie1, tie2, ties = ids[rank], tie1[rank], tie2[rank], block.column("tie").take(pa.array(rank))
        which, at, to, h1, h2 = units(block.column("t").take(pa.array(rank)))
        if not len(which):
            continue
        doc, tie1, tie2 = ids[which], tie1[which], tie2[which]
        h2 = h2.view(np.uint64) >> np.uint64(32)
        order = np.lexsort((h2, h1))  # stable, so by rank within a digest
        a, b = h1[order], h2[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        first = order[starts[np.cumsum(new) - 1]]
        known = np.zeros(len(a), dtype=bool)
        known[order] = (doc[order] != doc[first]) | (tie1[order] != tie1[first]) | (tie2[order] != tie2[first]) | (at[order] != at[first])
        often = (np.diff(np.append(starts, len(a))) >= OFTEN) | np.isin(a[starts], before)
        before = a[starts]
        if earliest:
            often |= np.isin(a[starts], np.fromiter((k[0] for k in earliest), np.int64, len(earliest)))
        for i in order[starts[often]].tolist():
            key, own = (int(h1[i]), int(h2[i])), (int(doc[i]), int(tie1[i]), int(tie2[i]), int(at[i]))
            if key in earliest and earliest[key] < own:
                known[i] = True
            elif key in earliest or len(earliest) < REMEMBERED:
                earliest[key] = own
        own = mix(doc.view(np.uint64) ^ mix(at.view(np.uint64) + tie1 * _BASE2)).view(np.int64)
        span = (at << 32 | to) | np.where(known, _KNOWN, 0)
        columns = {"doc": pa.array(doc), "h1": pa.array(np.where(known, own, h1)), "h2": pa.array(h2.view(np.int64)), "span": pa.array(span)}
        out = pa.RecordBatch.from_pydict({"tie": ties.take(pa.array(which)), **columns} if tied else columns)
        for i in range(0, out.num_rows, 20_000):
            yield out.slice(i, 20_000)


def _cut(texts: pa.Array, spans: pa.Array) -> list:
    """Spans in characters, merged where only blanks part them, and the text without them, from spans in bytes."""
    merged_out, kept_out = [], []
    for t, own in zip(texts.to_pylist(), spans.to_pylist()):
        t = t or ""
        raw, merged = t.encode(), []
        for at, to in sorted((x["at"], x["to"]) for x in own or ()):
            if merged and (at <= merged[-1][1] or not raw[merged[-1][1] : at].strip(b" \t\r\x0b\x0c")):
                merged[-1][1] = max(merged[-1][1], to)
            else:
                merged.append([at, to])
        if not merged:
            merged_out.append([])
            kept_out.append(t)
            continue
        char = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
        edge = [0, *(x for span in merged for x in span), len(raw)]
        kept_out.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])).decode())
        merged_out.append([{"start": int(char[a]) - 1, "end": int(char[b - 1])} for a, b in merged])
    return [merged_out, kept_out]


def _keyed(docs: DataFrame, doc_id: str, text: str, doc: str, tie: str) -> DataFrame:
    """docs with columns doc (the id; those without one rank last) and tie: a digest of the text where the id doesn't name one row."""
    own = docs.withColumn(doc, F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)))
    shared = own.groupBy(doc).agg(F.count(F.lit(1)).alias(tie)).where(F.col(tie) > 1)
    if shared.isEmpty():  # each row has an id of its own, as documents should
        return own.withColumn(tie, F.lit(b"").alias(tie, metadata={"none": True}))
    (mark,) = free_name(own, "__mark")
    shared = shared.select(F.col(doc).bitwiseXOR(F.lit(0).cast("long")).alias(doc), F.lit(True).alias(mark))  # a new key: the join can split a hot one
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return own.join(shared, doc, "left").withColumn(tie, F.when(F.col(mark), digest).otherwise(F.lit(b""))).drop(mark)


def repeats(keyed: DataFrame, doc: str, tie: str, text: str = "text") -> DataFrame:
    """(doc, tie, spans): byte spans to remove from the text of each document that has some."""
    own = keyed.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), F.col(text).alias("t"))
    tied = not own.schema["tie"].metadata.get("none")
    schema = f"{'tie binary, ' if tied else ''}doc long, h1 long, h2 long, span long"
    rows = small_batches(own).where(F.length("t") > 0).mapInArrow(lambda batches: _first_in_block(batches, tied), schema).repartition("h1")
    rows = rows if tied else rows.withColumn("tie", F.lit(b""))
    at = F.shiftright(F.col("span").bitwiseAND(F.lit(2**63 - 1)), 32).cast("int").alias("at")
    rows = rows.select("doc", "tie", "h1", "h2", at, F.col("span").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("to"), (F.col("span") < 0).alias("known"))
    order = Window.partitionBy("h1", "h2").orderBy("doc", "tie", "at")
    again = rows.withColumn("rank", F.rank().over(order)).where((F.col("rank") > 1) | F.col("known"))
    return again.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "to")).alias("spans"))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text cut, and ``removed``: array of (start, end) in code points of the original text.

    A column of docs named removed is replaced; other columns stay as they are.
    """
    docs = docs.drop("removed")
    doc, tie, spans = free_name(docs, "__doc", "__tie", "__spans")
    keyed = _keyed(docs, doc_id, text, doc, tie)
    found = repeats(keyed, doc, tie, text).select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("spans").alias(spans))
    joined = keyed.join(found, [doc, tie], "left").select(*docs.columns, spans)

    def work(batch: pa.RecordBatch) -> list:
        return _cut(batch.column(text), batch.column(spans))

    return replace_columns(joined, text, {"removed": "array<struct<start:int,end:int>>", text: "string"}, work).select(*docs.columns, "removed")


def op6_line_hashes(docs: DataFrame) -> DataFrame:
    out = dedupe(docs.select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.length("text").cast("long").alias("kept_chars"), "text")
