"""Operator 3: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Texts are dealt to blocks of bounded size, which are written once.  Every block sends its distinct words and bigrams,
with their counts in training texts, to shards by hash, as sorted arrays; a shard merges what it gets into the model's
sorted arrays and answers each block with the counts of what the block asked for.  So the model is never in one place:
a worker maps the slice of it that its block needs (Arrow's buffers, viewed by numpy without a copy), and
probabilities are looked up there by binary search.

Between blocks and shards stand the nodes of a tree (``Tree``).  A node of a level gets the messages of as many children as the
tree has branches, merges them, so that what they share goes on once, and asks as many nodes of the next level, each for its part
of the hashes; the last level are the shards, and answers come back the same way.  So messages grow with the number of blocks
(times branches and levels) and not with its square, and a node gets about as many as it has branches.  Up to ``BRANCHES``
blocks there is one level: blocks ask shards.  What nodes of lower levels were asked is written, as they need it again for their answers.

Bigrams go to the shard of their first word, whose followers' counts are summed there; a first word with very many
occurrences is no hot spot, as each child sends each distinct follower once.  How many words a word follows is summed
by shard, and these sums go up a tree to the shard of that word.

Discounts D1, D2, D3+ are those of modified Kneser-Ney, from the numbers of bigrams seen once to four times; the
unigram level takes continuation counts, discounted likewise, and is interpolated with 1 / (V + 1).

The first token of a text follows the end of a text.  A null text is an empty one: one token, the end.  Repeated rows
are texts of their own.  Rows without an id are scored, and are held out from training.  A text of any length lies whole in one
block.  An empty table gives no rows; columns beside doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, small_batches
from tapeworks.llm.words import gather, split_words

FOLDS, HELD = 7, 2
#: Bytes of text in a block.
BLOCK_BYTES = 5_000_000
END = np.uint64(0x8F1BBCDC5A827999)
#: Most children of a node, and most nodes that it asks.
BRANCHES = 1024
#: Bits of a follower's hash that are left out; 40 stay, so that of a billion words one in a thousand shares them.
_CUT = np.uint64(24)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one Arrow stream; whole numbers are cut to the bytes that their largest value needs, up to eight."""
    batch = pa.RecordBatch.from_arrays([pa.array(_narrow(x)) for x in arrays], [str(i) for i in range(len(arrays))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest unsigned type that holds it; nothing here is negative."""
    if not len(x) or x.dtype.kind != "i":
        return x
    return x.astype(np.min_scalar_type(int(x.max())))


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences, by byte place, so that the high bytes compress."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def unpack(raw: bytes) -> list[np.ndarray]:
    """The arrays again, as views of Arrow's buffers."""
    with pa.ipc.open_stream(pa.py_buffer(raw)) as source:
        table = source.read_all().combine_chunks()
    return [c.chunk(0).to_numpy() if c.num_chunks else c.to_numpy() for c in table.columns]


def block_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end of each text), and the text of each."""
    w = split_words(texts)
    n = len(texts)
    at = w.first[1:]
    return np.insert(w.hash, at, END), np.insert(w.text, at, np.arange(n))


def _ids(vocabulary: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.searchsorted(vocabulary, key)


class Block:
    """The tokens of a block by their place in its sorted vocabulary, and its distinct bigrams in order."""

    def __init__(self, raw: bytes):
        import zstandard

        self.docs = pa.ipc.open_stream(pa.py_buffer(zstandard.ZstdDecompressor().decompress(raw))).read_all().combine_chunks()
        token, self.text = block_tokens(self.docs.column("text").chunk(0))
        self.train = ~self.docs.column("held").to_numpy()[self.text]
        self.vocabulary = np.unique(np.append(token, END))
        self.token = _ids(self.vocabulary, token)
        self.before = np.concatenate([[_ids(self.vocabulary, END)], self.token[:-1]])
        self.pairs, self.pair = np.unique(self.before * len(self.vocabulary) + self.token, return_inverse=True)

    def counts(self, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[self.train], minlength=n)


@dataclass(frozen=True)
class Tree:
    """The way from blocks to shards.  A node of a level is a group of blocks' seats and the first digits of the shards that it stands for."""

    depth: int
    branches: int

    @staticmethod
    def over(blocks: int, most: int = BRANCHES) -> Tree:
        """The flattest tree with a shard for each block and no more than so many branches."""
        if most < 2:
            raise ValueError("most: at least 2")
        depth = 1
        while most**depth < blocks:
            depth += 1
        branches = max(1, int(blocks ** (1 / depth)))
        while branches**depth < blocks:
            branches += 1
        return Tree(depth, branches)

    @property
    def shards(self) -> int:
        return self.branches**self.depth

    def node(self, word: np.ndarray, level: int) -> np.ndarray:
        """The node of a level for each word, given by the 40 bits of its hash that are kept."""
        return (word % np.uint64(self.shards)).astype(np.int64) // self.branches ** (self.depth - level)

    def group(self, block: int) -> int:
        """The group of a block at the first level; a group's own group is a branches-th of it."""
        seat = (block * 0x9E3779B97F4A7C15 % 2**64 >> 24) % self.shards
        return seat // self.branches


def _parts(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of ``of``, and where each stands."""
    order = np.argsort(of, kind="stable")
    values, edge = np.unique(of[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, edge[1:]))


def make_blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, docs): the documents (doc_id, text, held) in compressed blocks."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(True)).alias("held"),
    )

    def run(batches):
        import zstandard

        for block in gather(batches, "text", limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as stream:
                stream.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=9).compress(sink.getvalue())], pa.binary())], ["docs"])

    return small_batches(own).mapInArrow(run, "docs binary").withColumn("block", F.monotonically_increasing_id())


#: What nodes send: messages to a node (grp, node) from a child, and answers to one, whose child is the part of the hashes that they are of.
_SENT = "kind string, grp long, node long, child long, keys binary, data binary, followers binary"


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of _SENT as a table."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["kind", "grp", "node", "child", "keys", "data", "followers"])


def _rows(table: pa.Table, *columns: str) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in columns))


def _ask_pairs(tree: Tree, level: int, group: int, child: int, head: np.ndarray, follower: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """Messages about bigrams, sorted, to nodes of a level: the distinct first words, how many followers each has, the followers and their counts."""
    for node, on in _parts(tree.node(head >> _CUT, level)):
        heads, n = np.unique(head[on], return_counts=True)
        f = follower[on]
        yield "pairs", group, node, child, pack_sorted(heads), pack(n.astype(np.uint32)), pack((f & np.uint64(0xFFFFFFFF)).astype(np.uint32), (f >> np.uint64(32)).astype(np.uint8), count[on])


def _ask_words(tree: Tree, level: int, group: int, child: int, word: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    for node, on in _parts(tree.node(word >> _CUT, level)):
        yield "words", group, node, child, pack_sorted(word[on]), pack(count[on]), None


def _add_follows(tree: Tree, level: int, group: int, word: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """Messages about words, by 40 bits, and how many words they follow; they want no answer."""
    for node, on in _parts(tree.node(word, level)):
        yield "follows", group, node, None, pack_sorted(word[on]), pack(n[on]), None


def _asks(tree: Tree, pairs: bool):
    """Messages of blocks to the first level: words and their training counts, or bigrams and theirs."""

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist()):
                b = Block(raw)
                v, to = len(b.vocabulary), (tree, 1, tree.group(block), block)
                if pairs:
                    out = _ask_pairs(*to, b.vocabulary[b.pairs // v], b.vocabulary[b.pairs % v] >> _CUT, b.counts(b.pair, len(b.pairs)))
                else:
                    out = _ask_words(*to, b.vocabulary, b.counts(b.token, v))
                yield from _table(list(out)).to_batches()

    return run


class _Pairs:
    """The bigrams that a node was asked for: the distinct ones in order with their sums, and the place of each one asked among them."""

    def __init__(self, table: pa.Table):
        heads, followers, counts = [], [], []
        for keys, data, pairs in _rows(table, "keys", "data", "followers"):
            head, (n,), (low, high, count) = unpack_sorted(keys), unpack(data), unpack(pairs)
            heads.append(np.repeat(head, n))
            followers.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
            counts.append(count)
        self.edge = np.cumsum([0, *map(len, counts)])
        head, follower, count = (np.concatenate(x) for x in (heads, followers, counts))
        order = np.lexsort((follower, head))
        h, f = head[order], follower[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        place = np.cumsum(new) - 1
        self.head, self.follower = h[new], f[new]
        self.count = np.bincount(place, weights=count[order]).astype(np.int64)
        self.at = np.empty(len(order), dtype=np.int64)
        self.at[order] = place

    def answers(self, table: pa.Table, branches: int, found: np.ndarray) -> Iterator[tuple]:
        """Answers to the children, given those for the distinct bigrams."""
        node = table.column("node")[0].as_py()
        for i, child in enumerate(table.column("child").to_pylist()):
            yield "pairs", child, node // branches, node, None, pack(found[self.at[self.edge[i] : self.edge[i + 1]]]), None


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, and the sums of the values of each."""
    unique, inverse = np.unique(key, return_inverse=True)
    return [unique, *(np.bincount(inverse, weights=x, minlength=len(unique)).astype(np.int64) for x in values)]


def _read_sums(table: pa.Table, kind: str) -> list[np.ndarray] | None:
    """Sorted distinct keys of the messages of a kind, and the sum of each; None without messages."""
    got = [(unpack_sorted(keys), unpack(data)[0]) for k, keys, data in _rows(table, "kind", "keys", "data") if k == kind]
    return _sums(*(np.concatenate(x) for x in zip(*got))) if got else None


def _pass_pairs(tree: Tree, level: int):
    """A node of a lower level: what its children ask for, once, to the next level."""

    def run(table: pa.Table) -> pa.Table:
        group, p = table.column("grp")[0].as_py(), _Pairs(table)
        return _table(list(_ask_pairs(tree, level + 1, group // tree.branches, group, p.head, p.follower, p.count)))

    return run


def _return_pairs(tree: Tree, level: int):
    """A node of a lower level: answers to its children from those that it got."""

    def run(asked: pa.Table, got: pa.Table) -> pa.Table:
        p, data = _Pairs(asked), dict(_rows(got, "child", "data"))
        found = np.empty(len(p.head), dtype=np.int64)
        for node, on in _parts(tree.node(p.head >> _CUT, level + 1)):
            found[on] = unpack(data[node])[0]
        return _table(list(p.answers(asked, tree.branches, found)))

    return run


def _merge_pairs(tree: Tree):
    """One shard's bigrams: counts for each child that asked, sums for contexts and followers, counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        shard, p = table.column("node")[0].as_py(), _Pairs(table)
        out = list(p.answers(table, tree.branches, p.count))
        known = p.count > 0
        total = p.count[known]
        h, *sums = _sums(p.head[known], total, total == 1, total == 2, total > 2)
        out.append(("context", 0, shard, None, pack_sorted(h), pack(*sums), None))
        out += _add_follows(tree, 1, shard // tree.branches, *np.unique(p.follower[known], return_counts=True))
        out.append(("of counts", None, None, None, None, pack(np.bincount(np.minimum(total, 5), minlength=6)[1:5]), None))
        return _table(out)

    return run


def _pass_words(tree: Tree, level: int):
    def run(table: pa.Table) -> pa.Table:
        group, out = table.column("grp")[0].as_py(), []
        up = group // tree.branches
        if asked := _read_sums(table, "words"):
            out += _ask_words(tree, level + 1, up, group, *asked)
        if follows := _read_sums(table, "follows"):
            out += _add_follows(tree, level + 1, up, *follows)
        return _table(out)

    return run


def _answer_words(table: pa.Table, branches: int, word: np.ndarray, info: np.ndarray) -> Iterator[tuple]:
    for kind, child, node, keys in _rows(table, "kind", "child", "node", "keys"):
        if kind == "words":
            yield "info", child, node // branches, node, None, pack(*info[:, np.searchsorted(word, unpack_sorted(keys))]), None


def _return_words(tree: Tree, level: int):
    def run(asked: pa.Table, got: pa.Table) -> pa.Table:
        if not got.num_rows:
            return _table([])  # nothing but followers came here
        word, data = _read_sums(asked, "words")[0], dict(_rows(got, "child", "data"))
        info = np.empty((6, len(word)), dtype=np.int64)
        for node, on in _parts(tree.node(word >> _CUT, level + 1)):
            info[:, on] = np.stack(unpack(data[node]))
        return _table(list(_answer_words(asked, tree.branches, word, info)))

    return run


def _merge_words(tree: Tree):
    """One shard's words: count, context sums and number of words before, for each child that asked; totals."""

    def run(table: pa.Table) -> pa.Table:
        asked, follows = _read_sums(table, "words"), _read_sums(table, "follows")
        if not asked:
            return _table([])
        word, count = asked
        info = np.zeros((6, len(word)), dtype=np.int64)
        info[0] = count
        for kind, keys, data in _rows(table, "kind", "keys", "data"):
            if kind == "context":
                info[1:5, np.searchsorted(word, unpack_sorted(keys))] += np.stack(unpack(data))
        if follows:
            f, n = follows
            at = np.minimum(np.searchsorted(f, word >> _CUT), len(f) - 1)
            info[5] = np.where(f[at] == word >> _CUT, n[at], 0)
        known = info[5][info[5] > 0]
        totals = np.array([count.sum(), (count > 0).sum(), known.sum(), len(known), *np.bincount(np.minimum(known, 5), minlength=6)[1:5]], dtype=np.int64)
        return _table([*_answer_words(table, tree.branches, word, info), ("totals", None, None, None, None, pack(totals), None)])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of what is counted once to four times; 0.5 each where these don't tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.01, 0.01, 0.01], [0.99, 1.99, 2.99])


def _score_block(tree: Tree, total: dict):
    """Rows of scores from a block and the answers to what it asked."""
    d2, d1 = discounts(total["pairs"]), discounts(total["unigrams"])
    n, v, kinds = total["n"], total["v"], total["before"]

    def run(table: pa.Table) -> pa.Table:
        raw, got = None, {}
        for kind, part, data in _rows(table, "kind", "child", "data"):
            if kind == "docs":
                raw = data
            else:
                got[kind, part] = data
        b = Block(raw)
        dealt, size = tree.node(b.vocabulary >> _CUT, 1), len(b.vocabulary)
        info = np.zeros((6, size))
        for node, on in _parts(dealt):
            info[:, on] = np.stack(unpack(got["info", node]))
        first = b.pairs // size
        count = np.zeros(len(b.pairs))
        for node, on in _parts(dealt[first]):
            count[on] = unpack(got["pairs", node])[0]
        c, context, n1, n2, n3, before = info
        less = lambda x, d: np.maximum(x - np.where(x > 2, d[2], np.where(x > 1, d[1], d[0])), 0)
        left = (d1 * total["unigram_kinds"]).sum() / max(kinds, 1) if kinds else 1.0
        low = less(before, d1) / max(kinds, 1) + left / (v + 1)
        last = b.pairs % size
        spread = (d2[0] * n1 + d2[1] * n2 + d2[2] * n3)[first]
        seen = context[first] > 0
        p = np.where(seen, (less(count, d2) + spread * low[last]) / np.maximum(context[first], 1), low[last])
        texts = b.docs.num_rows
        per = lambda x: np.bincount(b.text, weights=x, minlength=texts)
        base = np.log10((c + 1) / (n + v + 1.0))
        return pa.table(
            {
                "doc_id": b.docs.column("doc_id"),
                "held_out": b.docs.column("held"),
                "n_tokens": np.bincount(b.text, minlength=texts).astype(np.int64),
                "n_known": per(c[b.token] > 0).astype(np.int64),
                "train_tokens": np.full(texts, n, dtype=np.int64),
                "base_score": per(base[b.token]),
                "score": (logs := per(np.log10(p)[b.pair])),
                "perplexity": 10.0 ** np.minimum(-logs / np.maximum(np.bincount(b.text, minlength=texts), 1), 300),
            }
        )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _climb(asks: DataFrame, tree: Tree, node) -> list[DataFrame]:
    """The messages to each level from those to the first; node(tree, level) is what a node of a lower level does."""
    levels = [asks]
    for level in range(1, tree.depth):
        levels[-1] = cut(levels[-1])
        levels.append(levels[-1].groupBy("grp", "node").applyInArrow(node(tree, level), _SENT))
    return levels


def _descend(answers: DataFrame, levels: list[DataFrame], tree: Tree, node) -> DataFrame:
    """The answers to blocks from those of the shards."""
    for level in reversed(range(1, tree.depth)):
        answers = levels[level - 1].groupBy("grp", "node").cogroup(answers.groupBy("grp", "node")).applyInArrow(node(tree, level), _SENT)
    return answers


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, branches: int = BRANCHES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs (doc_id, text).

    perplexity is 10 ** (-score / n_tokens).
    """
    blocks = cut(make_blocks(docs, block_bytes))
    tree = Tree.over(blocks.count(), branches)  # a shard holds about as much as a block
    asked = _climb(blocks.mapInArrow(_asks(tree, True), _SENT), tree, _pass_pairs)
    pairs = cut(asked[-1].groupBy("grp", "node").applyInArrow(_merge_pairs(tree), _SENT))
    words = blocks.mapInArrow(_asks(tree, False), _SENT).unionByName(pairs.where("kind = 'follows'"))
    looked_up = _climb(words, tree, _pass_words)
    words = cut(looked_up[-1].unionByName(pairs.where("kind = 'context'")).groupBy("grp", "node").applyInArrow(_merge_words(tree), _SENT))
    total = {"pairs": np.zeros(4), "n": 0, "v": 0, "before": 0, "unigrams": np.zeros(4), "unigram_kinds": np.zeros(3)}
    for r in pairs.where("kind = 'of counts'").select("data").toLocalIterator():  # four numbers from each shard
        total["pairs"] += unpack(r.data)[0]
    for r in words.where("kind = 'totals'").select("data").toLocalIterator():
        n, v, before, known, *ones = (int(x) for x in unpack(r.data)[0])
        total["n"], total["v"], total["before"] = total["n"] + n, total["v"] + v, total["before"] + before
        total["unigrams"] += ones
        total["unigram_kinds"] += [ones[0], ones[1], known - ones[0] - ones[1]]
    rows = blocks.select(F.lit("docs").alias("kind"), F.col("block").alias("grp"), F.lit(-1).cast("long").alias("child"), F.col("docs").alias("data"))
    for answers in (_descend(pairs.where("kind = 'pairs'"), asked, tree, _return_pairs), _descend(words.where("kind = 'info'"), looked_up, tree, _return_words)):
        rows = rows.unionByName(answers.select(*rows.columns))
    return rows.groupBy("grp").applyInArrow(_score_block(tree, total), SCORES)


def op3_kneser_ney(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
