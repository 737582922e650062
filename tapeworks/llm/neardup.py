"""Operator 2: near-duplicate detection by ProbMinHash, banding and verification.

A text's elements are its runs of five words, weighted by how often they occur, from 1 to ``HEAVIEST``.  For each element points
arrive in a Poisson process whose rate is its weight; each point falls on a register, and a register keeps its earliest
point's element.  An element whose next point is later than all registers' is done (early termination).  Two
texts agree in a register with the probability Jaccard similarity of their weights.  No weight is more than HEAVIEST
times another, so this is the Jaccard similarity of the sets divided by HEAVIEST at least, also for texts that differ in
a line that one of them repeats; the bands are made for that: a pair at the limit shares none of them once in 1400 times.

Texts that agree in all registers of a band share a bucket and are candidates.  Exact copies are one node.  Candidates
are verified by the exact Jaccard similarity of their sets of elements, 0.8 or more, and the classes are the connected
components of the links.  Pairs are never rows.  What buckets connect is a cluster:

* A cluster of at most ``BLOCK_BYTES`` and ``BLOCK_NODES`` meets in one task, which holds all of its pairs against each
  other and puts out one link for each node at most.
* In a larger cluster every node is first held against the ``HUBS`` hubs with which it shares most bands.  The
  components of these links are known before anything else is compared.  Then the nodes outside a cluster's largest
  component meet all of its nodes, block by block; a block joins components as it goes and puts out only the links that
  joined some, as links between components.  The blocks are those of the cluster or of its buckets, whichever move fewer rows.

So no link between nodes that share a bucket is lost to the components, and only nodes that are like many others but
linked to few of them cost more than their number.

A null text is an empty one; empty texts are copies of each other.  A text of fewer than five words is one element.
Each row gets a class, repeated rows and rows without an id too; a class id is the smallest id in the class.
Very long texts are split into words a slice at a time; an element takes eight bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.graph import components, parted_anew
from tapeworks.llm.shared import cut, free_name
from tapeworks.llm.words import append_columns, mix, replace_columns, split_words, windows

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Weight that an element approaches as it is repeated; once is 1.
HEAVIEST = 1.1
#: Hubs (one in each of its buckets) that a node of a large cluster is held against first: those with which it shares most bands.
HUBS = 3
#: What a task holds against each other at once: bytes of elements, and nodes.
BLOCK_BYTES, BLOCK_NODES = 2_000_000, 1000
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count), distinct elements of each text."""
    w = split_words(texts)
    h = windows(w.hash, WORDS)
    inside = w.text[: len(h)] == w.text[WORDS - 1 :] if len(h) else np.zeros(0, dtype=bool)
    text, h = w.text[: len(h)][inside], h[inside]
    n = np.diff(w.first)
    for size in range(1, WORDS):  # short texts
        at = np.flatnonzero(n == size)
        if len(at):
            own = np.full(len(at), np.uint64(size))
            for i in range(size):
                own = mix(own * _STEP + w.hash[w.first[at] + i])
            text, h = np.concatenate([text, at]), np.concatenate([h, own])
    both = mix(h ^ mix(text.astype(np.uint64) + _PLACE))
    _, at, count = np.unique(both, return_index=True, return_counts=True)
    at, count = at[order := np.argsort(at, kind="stable")], count[order]
    return text[at], h[at], count


def weights(count: np.ndarray) -> np.ndarray:
    """Weights of elements that occur so often."""
    return HEAVIEST - (HEAVIEST - 1) / count


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Elements of the m registers of each text, as uint64 (0 where a text has no elements)."""
    first = np.full(n_texts * m, np.inf)
    who = np.zeros(n_texts * m, dtype=np.uint64)
    x = np.zeros(len(text))
    step = 0
    while len(text):
        step += 1
        u = mix(element + np.uint64(step * int(_STEP) % 2**64))
        x = x - np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
        place = text * m + (mix(u ^ _PLACE) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, place, x)
        won = first[place] == x
        who[place[won]] = element[won]
        on = x < first.reshape(n_texts, m).max(axis=1)[text]
        if not on.all():
            text, element, weight, x = text[on], element[on], weight[on], x[on]
    return who.reshape(n_texts, m)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``bands`` (array of long; empty without elements): a hash of the registers of each band."""

    def work(texts: pa.Array) -> list:
        n = len(texts)
        of, element, count = elements(texts)
        who = prob_minhash(of, element, weights(count), n, BANDS * ROWS)
        some = np.bincount(of, minlength=n) > 0
        own = np.full((n, BANDS), _PLACE)
        for i in range(ROWS):
            own = mix(own * _STEP + who.reshape(n, BANDS, ROWS)[:, :, i])
        return [[b.view(np.int64) if s else [] for b, s in zip(own, some)]]

    return append_columns(docs, text, {"bands": "array<bigint>"}, work)


def element_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``elements``: the sorted distinct elements of the text (binary, eight bytes each)."""

    def work(texts: pa.Array) -> list:
        of, element, _ = elements(texts)
        order = np.lexsort((element, of))
        raw = element[order].astype("<u8").tobytes()
        edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]) * 8
        return [pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())]

    return append_columns(docs, text, {"elements": "binary"}, work)


def _similar(batch: pa.RecordBatch) -> list:
    out = []
    for a, b in zip(batch.column("elements_a").to_pylist(), batch.column("elements_b").to_pylist()):
        a, b = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)) or not len(a):
            out.append(0.0)
            continue
        both = np.sort(np.concatenate([a, b]), kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        out.append(shared / (len(a) + len(b) - shared))
    return [out]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with ``similarity``: the exact Jaccard similarity of both sets of elements."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("elements_a"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("elements_b"))
    both = pairs.join(left, "a").join(right, "b")
    return replace_columns(both, "elements_a", {"similarity": "double"}, _similar).select("a", "b", "similarity")


def joining_links(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between nodes of one block that join components: nodes of side 1 or 2 are held against those of side 0 or 2.

    Every pair whose components differ at its turn is verified, by counting shared elements for all partners at once.
    """
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.concatenate([[0], np.cumsum(size)])
    label = np.unique(comp, return_inverse=True)[1]
    partner = np.flatnonzero(side != 1)
    flat, starts = np.concatenate([code[edge[y] : edge[y + 1]] for y in partner]), np.concatenate([[0], np.cumsum(size[partner])[:-1]])
    mark = np.zeros(code.max() + 1, dtype=bool)
    out = []
    for x in np.flatnonzero(side != 0):
        meet = (label[partner] != label[x]) & (5 * np.minimum(size[partner], size[x]) >= 4 * np.maximum(size[partner], size[x]))
        if side[x] == 2:
            meet &= partner > x
        if not meet.any():
            continue
        own = code[edge[x] : edge[x + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        for y in partner[meet & (5 * shared >= 4 * (size[partner] + size[x] - shared))]:
            if label[y] != label[x]:
                out.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return out


def _groups(table: pa.Table):
    """(ids, comp, side, sets) of each group of a bin that has something to hold against each other."""
    group, ids, comp, side = (table.column(c).to_numpy() for c in ("g", "id", "comp", "side"))
    sets = [np.frombuffer(x, dtype="<u8") for x in table.column("elements").to_pylist()]
    order = np.argsort(group, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(at) > 1 and (side[at] != 1).any() and (side[at] != 0).any():
            yield ids[at], comp[at], side[at], [sets[i] for i in at]


def _join_bin(table: pa.Table) -> pa.Table:
    """Links (a, b) between components, from the groups of a bin."""
    out = [link for _, comp, side, sets in _groups(table) for link in joining_links(comp, comp, side, sets)]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _solve_bin(table: pa.Table) -> pa.Table:
    """(id, comp) of the nodes of a bin's whole clusters that have a link; comp is the smallest id of the component."""
    of: dict[int, int] = {}
    for group in _groups(table):
        own: dict[int, int] = {}

        def root(i: int, own: dict[int, int] = own) -> int:
            while own.get(i, i) != i:
                i = own[i]
            return i

        for a, b in joining_links(*group):
            a, b = root(a), root(b)
            own[max(a, b)] = own[min(a, b)] = min(a, b)
        of |= {i: root(i) for i in own}
    return pa.table({"id": pa.array(list(of), pa.int64()), "comp": pa.array(list(of.values()), pa.int64())})


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node and the HUBS hubs with which it shares most bands."""
    shared = buckets.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "hub"))
    return shared.withColumn("rank", best).where(F.col("rank") <= HUBS).select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _blocks(nodes: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(nodes) / BLOCK_NODES, F.col(size) / BLOCK_BYTES)).cast("int")


def _mixed(own: DataFrame) -> DataFrame:
    """For each group g of own (g, cluster, id, comp, size) with several components: the largest, blocks, and rows to move."""
    parts = own.groupBy("g", "cluster", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("g", "cluster").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "comp", "size")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    whole = whole.select("g", "cluster", F.col("m.comp").alias("main"), "n", "size", (F.col("n") - F.col("m.n")).alias("n_others"), (F.col("size") - F.col("m.size")).alias("size_others"))
    whole = whole.select("g", "cluster", "main", "n", "n_others", _blocks("n", "size").alias("blocks"), _blocks("n_others", "size_others").alias("others"))
    return whole.withColumn("moved", F.col("n") * F.col("others") + F.col("n_others") * F.col("blocks"))


def _solve_large(large: DataFrame, buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, comp) of the nodes of large clusters (id, cluster, size): components of the links to hubs, joined by the links that blocks find between them."""
    own = buckets.join(large.select("id", "cluster", "size"), "id")
    comps = components(verified(_hub_pairs(own), sets).where(F.col("similarity") >= SIMILARITY).select("a", "b"))
    known = lambda df: df.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    by_bucket = cut(known(own.select(F.col("b").alias("g"), "cluster", "id", "size")))
    by_cluster = cut(known(large.select(F.col("cluster").alias("g"), "cluster", "id", "size")))
    of_bucket, of_cluster = _mixed(by_bucket), _mixed(by_cluster)
    dear = of_bucket.groupBy("cluster").agg(F.sum("moved").alias("by_bucket")).join(of_cluster.select("cluster", "moved"), "cluster").where("by_bucket < moved").select("cluster")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    items = []
    for rows, groups, how in ((by_cluster, of_cluster, "left_anti"), (by_bucket, of_bucket, "left_semi")):
        met = rows.join(parted_anew(groups.join(dear, "cluster", how).drop("cluster"), "g"), "g")
        zero = met.select("g", "id", "comp", F.lit(0).alias("side"), deal("blocks").alias("i"), every("others").alias("j"))
        one = met.where("comp <> main").select("g", "id", "comp", F.lit(1).alias("side"), every("blocks").alias("i"), deal("others").alias("j"))
        items.append(zero.unionByName(one))
    both = items[0].unionByName(items[1]).join(sets, "id").withColumn("bin", F.xxhash64("g", "i", "j"))
    met = components(both.select("bin", "g", "id", "comp", "side", "elements").groupBy("bin").applyInArrow(_join_bin, "a long, b long"))
    met = parted_anew(met.select(F.col("id").alias("comp"), F.col("comp").alias("joined")), "comp")
    return by_cluster.join(met, "comp", "left").select("id", F.coalesce("joined", "comp").alias("comp"))


def digest(text: str) -> Column:
    """What tells texts apart; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc, comp): the digest of each text, its smallest id, and the component that it is in."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"), digest(text).alias("key"))
    nodes = signatures(own, "t").groupBy("key").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    rows = nodes.select("id", F.posexplode("bands").alias("band", "hash")).select("id", F.xxhash64("band", "hash").alias("b"))
    least = F.min("id").alias("hub")  # the smallest id, about which components are stars too
    hubs = parted_anew(rows.groupBy("b").agg(least, F.count("*").alias("n")).where("n > 1").select("b", "hub"), "b")
    buckets = cut(rows.join(hubs.hint("merge"), "b"))
    clusters = components(buckets.select("id", "hub"), "id", "hub").select("id", F.col("comp").alias("cluster"))
    need = nodes.join(clusters, "id").select("key", "id", "doc", "cluster")
    sets = own.join(need, (own.key == need.key) & own.doc.eqNullSafe(need.doc)).select("id", "cluster", "t").dropDuplicates(["id"])
    sets = cut(element_sets(sets, "t").drop("t"))
    light = sets.select("id", "cluster", F.length("elements").alias("size"))
    sizes = light.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))
    sizes = cut(sizes.withColumn("large", _blocks("n", "bytes") > 1))
    total = sizes.agg(F.max("large").alias("large"), F.sum(F.when(~F.col("large"), F.col("bytes"))).alias("bytes")).first()
    of_size = lambda large: parted_anew(sizes.where(F.col("large") == large).select("cluster"), "cluster")
    bins = (total.bytes or 0) // BLOCK_BYTES + 1
    small = sets.join(of_size(False), "cluster").select(
        F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"), F.col("cluster").alias("g"), "id", F.col("id").alias("comp"), F.lit(2).alias("side"), "elements"
    )
    comps = small.groupBy("bin").applyInArrow(_solve_bin, "id long, comp long")
    if total.large:
        comps = comps.unionByName(_solve_large(cut(light.join(of_size(True), "cluster")), buckets, sets.select("id", "elements")))
    comps = comps.hint("merge")
    return nodes.select("id", "key", "doc").join(comps, "id", "left").select("key", "doc", F.coalesce("comp", "id").alias("comp"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc): digest and id of one text of each class: the smallest id, then digest; without an id if none has one."""
    order = F.struct(F.col("doc").isNull().alias("last"), F.col("doc"), F.col("key"))
    first = _grouped(docs, doc_id, text).groupBy("comp").agg(F.min(order).alias("x"))
    return first.select("x.key", "x.doc")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with ``class_id``: the smallest id among the documents of the class."""
    of = _grouped(docs, doc_id, text)
    least = parted_anew(of.groupBy("comp").agg(F.min("doc").alias("class_id")), "comp")
    of = of.join(least, "comp").select("key", "class_id")
    (name,) = free_name(docs, "__key")
    of = of.select(F.concat("key", F.lit(b"")).alias(name), "class_id")
    out = docs.drop("class_id").withColumn(name, digest(text)).drop(text)
    return out.join(of, name).drop(name)


def op2_prob_minhash(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text"))
