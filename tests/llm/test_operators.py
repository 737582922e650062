"""The training-data operators against brute force, round trips and held-out accuracy, on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from tapeworks.llm import bpe, graph, kneserney, licenses, neardup, packing, pii, quality, substrings, topk, toxicity
from tests.conftest import DATA

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "A b C d", "é😀 ñ x", "word " * 400]
    base = [sentence(rng, 120) for _ in range(12)]
    for t in base:
        w = t.split()
        out += [t, t, " ".join(w[:60] + ["changed"] + w[61:]), t + "\n" + base[0][:300]]
    out += pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()[:60]
    out += ["1" * 3000, "a." * 3000, "long " + "x" * 30_000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with nulls, repeated rows and columns whose names clash with results."""
    rows = [(i, t, "en", "src", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def empty(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)).round(3).tolist()
    v[100], v[150], v[151] = v[0], None, [float("nan")] * 8
    v[152], v[153] = [None] * 8, v[154]
    e = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    got = {}
    for r in topk.op1_pivot_topk(e).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = {i: np.floor(1024 * np.array(a, dtype=np.float32).astype(float)).astype(int) for i, a in enumerate(v) if a and all(y is not None and math.isfinite(y) for y in a)}
    for q in range(0, 700, 100):
        want = sorted(((-int(x[q] @ y), i) for i, y in x.items() if i != q))[:10]
        assert [got[q][k + 1] for k in range(10)] == [(i, -s) for s, i in want]
    assert topk.op1_pivot_topk(e.where("false")).count() == 0


def test_topk_in_blocks_with_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(21)
    rows = [(int(i), rng.integers(-9, 10, size=n).tolist()) for n in (3, 5) for i in rng.integers(0, 300, size=250)]
    rows += [(300, rng.integers(-9, 10, size=5).tolist()) for _ in range(40)] + rows[:7] + [(600, [1] * 7)]
    d = spark.createDataFrame(rows, "vec_id long, v array<long>")
    want = {}
    for q, a in rows:
        for i, b in rows:
            if q % 5 == 0 and i != q and len(a) == len(b):
                s = int(np.dot(a, b))
                want.setdefault(q, {})[i] = max(s, want.get(q, {}).get(i, s))
    want = {(q, k + 1, i, s) for q, own in want.items() for k, (i, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:4])}
    for size in (100_000, 1000):
        got = [tuple(r) for r in topk.top_k(d.repartition(5), F.col("vec_id") % 5 == 0, k=4, block_bytes=size).select("query_id", "rank", "vec_id", "score").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in neardup.op2_prob_minhash(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    again = neardup.classes(docs.unionByName(docs).withColumn("CLASS_ID", F.lit(1)))
    assert again.count() == 2 * len(texts)
    assert neardup.op2_prob_minhash(empty(docs)).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 2**63, 300, dtype=np.uint64)
    w = rng.integers(1, 9, 300).astype(float)
    a, b = np.arange(0, 220), np.arange(80, 300)
    pa_, pb = w[a] / w[a].sum(), w[b] / w[b].sum()
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = pa_, pb
    both = np.flatnonzero((x > 0) & (y > 0))
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    m = 4000
    sig = neardup.prob_minhash(np.r_[np.zeros(220, int), np.ones(220, int)], element[np.r_[a, b]], w[np.r_[a, b]], 2, m)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / m)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_kneser_ney_equals_brute_force(spark, docs, texts):
    tokens = {i: [*words(t), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count, pair = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            count.update(t)
            pair.update(zip([None, *t[:-1]], t))
    context, kinds, before = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), k in pair.items():
        context[a] += k
        kinds[a][min(k, 3) - 1] += 1
        before[b] += 1
    of = lambda c: kneserney.discounts(np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]))
    d2, d1, n, v, total = of(pair), of(before), sum(count.values()), len(count), sum(before.values())
    less = lambda x, d: max(x - d[min(x, 3) - 1], 0) if x else 0
    left = sum(d1[min(k, 3) - 1] for k in before.values()) / total
    low = lambda w: less(before[w], d1) / total + left / (v + 1)
    p = lambda a, b: (less(pair[a, b], d2) + sum(x * y for x, y in zip(d2, kinds[a])) * low(b)) / context[a] if context[a] else low(b)
    for r in kneserney.score(docs, 20_000).union(kneserney.score(docs, 2_000, branches=3)).collect():  # blocks ask shards; or through a tree
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None, *t[:-1]], t)), rel=1e-6)
    assert kneserney.op3_kneser_ney(empty(docs)).count() == 0


def test_kneser_ney_tree_is_no_deeper_than_it_must_be():
    rng = np.random.default_rng(6)
    for blocks, most, depth in ((0, 4, 1), (1, 4, 1), (4, 4, 1), (5, 4, 2), (16, 4, 2), (17, 4, 3), (1024, 1024, 1), (1025, 1024, 2), (10**9, 1024, 3)):
        tree = kneserney.Tree.over(blocks, most)
        assert tree.depth == depth and tree.branches <= most and tree.shards >= max(blocks, 1)
        word = rng.integers(0, 2**40, 1000).astype(np.uint64)
        for level in range(1, depth + 1):
            node = tree.node(word, level)
            assert node.min() >= 0 and node.max() < tree.branches**level
            assert level == 1 or (node // tree.branches == tree.node(word, level - 1)).all()
        assert all(0 <= tree.group(b) < max(1, tree.branches ** (depth - 1)) for b in range(0, 1 << 40, 12_345_678_901))
    with pytest.raises(ValueError):
        kneserney.Tree.over(5, 1)


def test_kneser_ney_sends_what_grows_with_blocks(spark, docs):
    """Messages to each level number a tree's branches for each block at most, and no node gets more than fits its children."""
    blocks = kneserney.cut(kneserney.make_blocks(docs.select("doc_id", "text"), 1_500))
    n = blocks.count()
    tree = kneserney.Tree.over(n, 3)
    assert n > 27 and tree.depth > 3
    sent = kneserney._climb(blocks.mapInArrow(kneserney._asks(tree, True), kneserney._SENT), tree, kneserney._pass_pairs)
    for level in sent:
        assert level.count() <= tree.shards * tree.branches
    top = sent[-1].groupBy("grp", "node").count().agg({"count": "max", "grp": "max"}).first()
    assert top["max(count)"] <= tree.branches and top["max(grp)"] == 0


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for window in (4096, 64):
        pieces = packing.pack(docs, path, window).toPandas()
        for i, t in enumerate(texts):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            at = 0
            for r in pieces[pieces.doc_id == i].sort_values("start").itertuples():
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        short = 0
        for _, g in pieces.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= window
            short += g.length.sum() < window
        assert short <= 1
    assert packing.pack(empty(docs), path).count() == 0


def test_packing_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(4)
    for window, least, have in ((64, 0.6, {n: 40 for n in range(1, 64)}), (4096, 0.7, collections.Counter(np.minimum(4095, rng.lognormal(6.4, 0.8, 3000).astype(int) + 1).tolist()))):
        rows, sequences = packing.plan(dict(have), window)
        used, filled = collections.Counter(), collections.Counter()
        taken = set()
        for length, a, b, first, each, slot, before in rows:
            assert used[length] == a
            used[length] = b
            for j in range(before, before + b - a):
                place = first + j // each, slot + j % each
                assert place not in taken
                taken.add(place)
                filled[place[0]] += length
        assert all(used[n] <= have[n] for n in used) and set(filled) == set(range(sequences)) and max(filled.values()) <= window
        tokens = sum(n * c for n, c in have.items())
        assert sum(filled.values()) > least * tokens and sum(used.values()) > least * sum(have.values())
        assert sequences * window <= tokens
    assert packing.plan({}, 4096) == ([], 0) and packing.plan({5: 3}, 4096)[1] == 0


def test_packing_ids_equal_those_of_the_library_for_all_characters():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.WordIds(path)
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 37 == 0)]
    texts = [" ".join(f"ab{c}cd {c} 7{c}T{c}" for c in chars[i : i + 400]) for i in range(0, len(chars), 400)]
    marks = "\u0308\u030c\u0331\u030a\u0301\u0327\u05b0\u3099"
    texts += [" ".join(f"{a}{m} {a}{m}x {m}{a}" for a in "JTHWEaoeuA\u0130\u03a3\u00df\u1e9e\uac00\u1100" for m in marks)]
    texts += ["a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> don't WE'LL it's'd !'s ''", "\u0391\u03a3 \u1e9eS \u0130I e\u0301\u0327 \u00a0\u2028\u3000x"]
    rng = random.Random(8)
    texts += ["".join(rng.choice(chars[:5000] + list(marks) * 60 + [" "] * 700) for _ in range(3000)) for _ in range(20)]
    for t in texts:
        ids, edge = own.encode(pa.array([t]))
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, [w for w in t.split(" ") if own.encode(pa.array([w]))[0].tolist() != tok.encode(w, add_special_tokens=False).ids][:3]


def test_byte_bpe_equals_tiktoken(spark, docs, texts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.op5_byte_bpe(docs, path, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = np.array(enc.encode_ordinary(t), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    some = docs.where("doc_id = 5")
    r = bpe.encode(some, path, P.PATTERN, offsets=True).first()
    t = texts[5]
    assert r.starts[0] == 0 and r.ends[-1] == len(t) and all(a < b for a, b in zip(r.starts, r.ends))
    assert bpe.op5_byte_bpe(empty(docs), path, P.PATTERN).count() == 0


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(9)
    passage = ". ".join(" ".join(f"{rng.choice(WORDS)}{rng.randrange(999)}" for _ in range(9)) for _ in range(7)) + "."
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts = [None, "", fresh(80), f"{fresh(30)} {passage} {fresh(30)}", f"{fresh(25)} {passage} {fresh(40)}", passage, fresh(80)]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, removed int")
    got = {r.doc_id: r for r in substrings.dedupe(d).collect()}
    for i in (2, 3, 6):
        assert not got[i].removed and got[i].text == texts[i]
    for i in (4, 5):
        gone = sum(b - a for a, b in got[i].removed)
        assert gone > 0.75 * len(passage)
        kept = "".join(c for k, c in enumerate(texts[i]) if not any(a <= k < b for a, b in got[i].removed))
        assert kept == got[i].text
    assert substrings.dedupe(d.unionByName(d)).where("size(removed) > 0").count() == 4
    assert substrings.op6_line_hashes(d.where("false")).count() == 0


def brute_units(t):
    """(kind, words), first byte and the byte after the last of each unit, by plain Python; only a word's hash is the operator's."""
    raw = t.encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    own = [raw[x:y].lower() for x, y in at]
    distinct = sorted(set(own))
    value = dict(zip(distinct, substrings.split_words(pa.array([w.decode() for w in distinct], pa.string())).hash.tolist()))
    h, n = [value[w] for w in own], len(own)
    line = [i == 0 or b"\n" in raw[at[i - 1][1] : at[i][0]] for i in range(n)]
    part = [i == 0 or own[i - 1][-1:] in (b".", b"!", b"?") for i in range(n)]
    for i in range(n - substrings.WINDOW + 1):
        window = h[i : i + substrings.WINDOW]
        part[i + max(k for k, x in enumerate(window) if x == min(window))] = True
    out = set()
    starts = [i for i in range(n) if line[i]] + [n]
    out |= {(1, x, y) for x, y in zip(starts, starts[1:]) if y - x >= substrings.LINE_WORDS}
    for edge in (part, [x or y for x, y in zip(part, line)]):
        starts = [i for i in range(n) if edge[i]] + [n]
        for x in starts[:-1]:
            out |= {(2, x, y) for y in [next((y for y in starts if y >= x + substrings.PASSAGE_WORDS), None)] if y}
    return [((kind, tuple(own[x:y])), at[x][0], at[y - 1][1]) for kind, x, y in sorted(out, key=lambda u: (u[1], u[2]))]


def brute_repeats(rows):
    """For each (id, text) of rows: which bytes of the text go."""
    several = {i for i, n in collections.Counter(i for i, _ in rows).items() if n > 1}
    tie = lambda i, t: hashlib.md5(t.encode()).digest() if i is None or i in several else b""
    first, want = {}, {}
    ranked = sorted({(i is None, i or 0, tie(i, t or ""), t or "") for i, t in rows})
    for none, i, _, t in ranked:
        gone = np.zeros(len(t.encode()), dtype=bool)
        mine = {}
        for unit, x, y in brute_units(t):
            if unit in first or unit in mine:
                gone[x:y] |= (first.get(unit) or mine[unit]) != (none, i, t, x)
            mine.setdefault(unit, (none, i, t, x))
        first = mine | first
        want[None if none else i, t] = gone
    return want


def assert_cut(want, before, removed, text):
    """removed and text are what is left of a text whose bytes in want go, with the blanks between them."""
    char = np.cumsum((np.frombuffer(before.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1 if before else np.zeros(0, int)
    cut = {int(c) for c in char[want]}
    spans = {k for x, y in removed for k in range(x, y)}
    assert cut <= spans and all(before[k].isspace() for k in spans - cut) and text == "".join(c for k, c in enumerate(before) if k not in spans)


def test_repeats_equal_brute_force(spark, docs, texts, monkeypatch):
    """The earliest occurrence of each unit stays; in one block and in blocks of a text each."""
    rng = random.Random(77)
    line = " ".join(f"common{i}" for i in range(12))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    rows = [(r, t) for r, t in enumerate(texts)] + [(100 + i, f"{sentence(rng, 20)}\n{line}\n{sentence(rng, 15)} {passage if i % 3 == 0 else ''} {sentence(rng, 9)}") for i in range(40)] + [(None, line), (7, line), (7, line)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    for size in (2_000_000, 1):
        monkeypatch.setattr(substrings, "BLOCK_BYTES", size)
        for r in substrings.dedupe(d.withColumn("before", F.col("text"))).collect():
            t = r.before or ""
            assert_cut(want[r.doc_id, t], t, [(x["start"], x["end"]) for x in r.removed], r.text)
    assert substrings.op6_line_hashes(d.where("false")).count() == 0


def test_texts_without_an_id_of_their_own_are_told_apart(spark):
    """Two texts of one crc32 and different lengths, once without an id and once with the same one; rows of them twice."""
    line = " ".join(f"shared{i}" for i in range(30))
    seen = {}
    for k in range(10**6):
        t = f"{line}\n{k} " + "tail " * (150 * (k % 2))
        other = seen.setdefault(zlib.crc32(t.encode()), t)
        if len(other) != len(t):
            break
    assert zlib.crc32(t.encode()) == zlib.crc32(other.encode())
    for doc in (None, 4):
        rows = [(1, "words before\n" + line), (doc, t), (doc, other), (doc, t), (doc, "a text of its own")]
        want = brute_repeats(rows)
        got = substrings.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("before", F.col("text"))).collect()
        assert len(got) == 5
        for r in got:
            assert_cut(want[r.doc_id, r.before], r.before, [(x["start"], x["end"]) for x in r.removed], r.text)
            assert line not in r.text or r.doc_id == 1


def test_units_hash_alike_wherever_they_stand():
    rng = random.Random(2)
    passage = " ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(90))
    a = substrings.units(pa.array([f"x y {passage}"]))
    b = substrings.units(pa.array(["other text", f"one more\nq {passage.upper()} end"]))
    assert len(set(zip(a[3], a[4])) & set(zip(b[3], b[4]))) >= 3


def base_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, p in patterns.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[k]()
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii_equals_brute_force(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "+d@e.f", ".", "1.2.3.4", ".5.6.7.8", "+1 (017) 555-7713", "4736962573099581", " ", "-", "é😀", "@", "12", "x.y", "300.1.1.1", "0255.1.1.001", "4111 1111 1111 1111", "\n"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(300)), "a@b.cc " * 600, "1" * 5000, "IBAN DE89370400440532013000 ssn 123-45-6789"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    got = {r.doc_id: r for r in pii.op7_pii(d).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()
    assert got[len(texts) - 1].spans == "iban:5:27,ssn:32:43"
    clean = pii.redact(pii.find(d))
    assert all(r.text.count("@b.c") == 0 for r in clean.where("doc_id = 302").collect())
    assert pii.op7_pii(d.where("false")).count() == 0


def test_quality_counts(spark, docs, texts):
    for r in quality.rules(docs.select("doc_id", "text")).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert quality.op8_compression_bands(docs, labels).count() == len(texts)
    assert quality.op8_compression_bands(empty(docs), labels).count() == 0


def test_quality_bands_equal_brute_force(spark):
    import zstandard

    rng = random.Random(14)
    fresh = [f"{rng.choice(WORDS)}{rng.randrange(4000)}" for _ in range(6000)]
    few = [f"{w}###" for w in WORDS]
    rows, labels = [], []
    for i in range(500):
        good = i % 5 != 0
        n = int(rng.lognormvariate(5.3, 0.7)) + 60
        rows.append((i, " ".join(rng.choice(fresh if good else few) for _ in range(n))))
        labels.append((i, int(good), 0))
    noise = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(300))
    mixed = " ".join(rng.choice(fresh) for _ in range(1500)) + " " + " ".join(rng.choice(few) + str(rng.randrange(3)) for _ in range(1500))
    long = [rng.choice(fresh) for _ in range(60000)]
    tail = " ".join(long[:5000]) + " " + " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20))
    rows += [(900, noise), (901, mixed), (902, None), (903, ""), (904, " ".join(long)), (905, " ".join(long[:60] * 1000)), (906, tail[: 9 * quality.CHUNK_BYTES + 9] + tail[-1000:])]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bands = quality.fit_bands(d, lab)
    assert bands != quality.DEFAULT and quality.fit_bands(d, lab.where("false")) == quality.DEFAULT
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    usual = lambda size: float(np.interp(math.log2(size), bands.knots, bands.usual)) + bands.rise * max(0, math.log2(size) - bands.knots[-1])
    got = {r.doc_id: r for r in quality.op8_compression_bands(d, lab).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        n = quality.CHUNK_BYTES
        chunks = [raw[k : k + n] for k in range(0, len(raw) - n + 1, n)] + ([raw[-n:]] if len(raw) >= n else [])
        parts = [len(c) / len(compress(c)) / usual(len(c)) for c in chunks]
        whole = not raw or bands.whole[0] <= len(raw) / len(compress(raw)) / usual(len(raw)) <= bands.whole[1]
        assert got[i].kept == (not got[i].base_failed and whole and all(bands.chunk[0] <= x <= bands.chunk[1] for x in parts)), i
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0 and not got[i].base_failed]
    assert all(got[i].kept for i in held if i % 5) and not any(got[i].kept for i in held if i % 5 == 0)
    assert not got[900].kept and not got[901].kept
    assert max(len(t) for _, t in rows[:500]) < 150_000 < len(rows[-3][1]) and got[904].kept and not got[905].kept  # longer than all that taught
    assert not got[906].base_failed and not got[906].kept  # only its last thousand bytes are random
    again = spark.createDataFrame([(i, f"~{t}") for i, t in rows[:500]], "doc_id long, text string").unionByName(d)
    assert quality.fit_bands(again.repartition(7), lab) == bands  # of a repeated id, the least text


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    rows, labels = [(-1, None), (-2, "")], [(None, 1, None)]
    for i in range(1200):
        toxic = i % 5 == 0
        w = sentence(rng, rng.randrange(40, 200)).split()
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "numbskull", "nitwit"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.op9_toxicity(d.withColumn("score", F.lit("x")), lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and got.score.between(0, 1).all()
    assert toxicity.op9_toxicity(d, lab.where("false")).count() == len(rows)
    assert toxicity.op9_toxicity(d.where("false"), lab).count() == 0


def test_toxicity_models_equal_brute_force(spark):
    """Counts of all tasks against plain counting, and Kneser-Ney probabilities against their definition; the least text of a repeated id."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["you", "Fool", "kind", "été", "x"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(3, "a twice used id"), (5, None), (None, "no id")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(6, 1, 0)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    toxic = {i: max(t for j, _, t in labels if j == i) for i, _, _ in labels}
    learnt = {i: min(t for j, t in rows if j == i and t is not None) for i in toxic if zlib.crc32(str(i).encode()) % 5}
    counts = collections.Counter(b for t in learnt.values() for b in t.encode())
    assert (model.symbol == toxicity.alphabet(np.array([counts[b] for b in range(256)]))).all()
    grams = [collections.Counter(), collections.Counter()]
    for i, t in learnt.items():
        if zlib.crc32(f"aside{i}".encode()) % toxicity.ASIDE:
            s = [0] * 3 + [int(model.symbol[b]) for b in t.encode()]
            grams[toxic[i]].update(tuple(s[k : k + 4]) for k in range(len(s) - 3))
    both = collections.Counter(g[-1] for c in grams for g in c.elements())
    total = sum(both.values()) + toxicity.SYMBOLS
    shared = lambda x: (both[x] + 1) / total

    def levels(c):
        out = [c]
        for _ in range(2):
            out.append(collections.Counter(g[1:] for g in out[-1]))
        return out

    def p(own, gram):
        if not own:
            return shared(gram[-1])
        c, rest = own[0], own[1:]
        ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
        less = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        after = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        lower = p(rest, gram[1:])
        return (max(c[gram] - less, 0) + less * len(after) * lower) / sum(after) if after else lower

    for gram in rng.sample(sorted(grams[0] | grams[1]), 60) + [(1, 2, 3, 39), (0, 0, 0, 0)]:
        at = sum(x * toxicity.SYMBOLS ** (3 - k) for k, x in enumerate(gram))
        want = math.log(p(levels(grams[1]), gram)) - math.log(p(levels(grams[0]), gram))
        assert model.ratio[at] == pytest.approx(want, abs=1e-4)
    texts = ["", "fool you", None, "", "kind x été", "Fool fool", ""]
    alone = np.concatenate([model.score(pa.array([t], pa.string())) for t in texts])
    assert model.score(pa.array(texts, pa.string())) == pytest.approx(alone, abs=1e-9)
    again = toxicity.train(d.repartition(2), lab)
    assert (again.ratio == model.ratio).all() and (again.weights == model.weights).all()


def test_licenses(spark, docs, texts):
    own = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "This is CC BY-NC 4.0; all rights reserved.", "GNU General Public License, version 3. general public\nlicense", "summit committed", None]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.op10_license_rules(d.withColumn("labels", F.lit(1))).collect()}
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(own))]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        base = [(label, k) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for _, k in base]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in base})) and 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert [got[1000 + i].labels for i in range(6)] == ["apache-2.0", "mit", "cc-by,cc-by-nc-4.0,reserved", "gpl,gpl-3", "", ""]
    assert len(licenses.rules()) > 200 and licenses.op10_license_rules(empty(docs)).count() == 0


def wordings(pattern):
    """Every text that a pattern of alternatives, options and sets matches; digits stand for one, repeats for the least and one more."""

    def ways(node):
        out = [""]
        for op, x in node:
            op = str(op)
            if op == "LITERAL":
                own = [chr(x)]
            elif op == "IN":
                own = [chr(v) if str(k) == "LITERAL" else c for k, v in x for c in ([None] if str(k) == "LITERAL" else [chr(v[0]), chr(v[1])])]
            elif op == "BRANCH":
                own = [y for branch in x[1] for y in ways(branch)]
            elif op == "SUBPATTERN":
                own = ways(x[-1])
            elif op == "MAX_REPEAT":
                own = [y * n for n in (x[0], x[0] + 1) for y in ways(x[2])]
            else:
                assert op == "ASSERT_NOT", op
                own = [""]
            out = [a + b for a in out for b in own]
        return out

    return sorted(set(ways(re._parser.parse(pattern))))


def test_license_signatures():
    own = [(label, phrase) for label, phrases in licenses.SIGNATURES.items() for phrase in phrases]
    assert len({p for _, p in own}) == len(own) and len(own) + len(licenses.TEXTS) > 200
    for label, phrase in own:
        w = phrase.split()
        assert re.fullmatch("[a-z0-9 ]+", phrase)
        for text in (phrase, f"so {phrase} x", ", ".join(w).upper(), "\n * ".join(w)):
            joined = licenses.words_of(text)[1]
            found = licenses.detect(joined)
            held = [x for x in own if f" {x[1]} " in joined]  # another signature may hold this one
            assert label in {x[0] for x in found} or any(len(x[1]) > len(phrase) for x in held), phrase
            assert found == licenses.detect(joined, every=True)
        i = len(w) // 2
        for other in (w[:i] + w[i + 1 :], [*w[:i], "otherwise", *w[i:]], w[1:] + w[:1], [w[0] + "s", *w[1:]], w[:-1]):
            joined = licenses.words_of(" ".join(other))[1]
            rule = [r for r in licenses.rules() if r[4].pattern == f"(?<= )(?:{phrase})(?= )"]
            assert len(rule) == 1 and rule[0][0] == label and not rule[0][4].search(joined) and licenses.detect(joined) == licenses.detect(joined, every=True)
    assert [x[0] for x in licenses.detect(licenses.words_of("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007")[1])] == ["gpl-3"]


def test_license_keywords_lose_no_wording():
    for label, _, name, address in licenses.FAMILIES:
        for phrase in wordings(name) + (wordings(address) if address else []):
            for text in (f"{phrase}", f"{phrase} license", f"{phrase} licence version 2", f"spdx license identifier {phrase}", f"code released under the {phrase} license 3 0 and so on"):
                joined = f" so {text} x "
                assert licenses.detect(joined) == licenses.detect(joined, every=True), joined
    found = {
        "GPLv2": "gpl", "GNU GPLv3 only": "gpl", "Expat license": "mit", "the PSF License": "python", "Alle Rechte vorbehalten": "reserved", "Todos los derechos reservados": "reserved",
        "Tous droits reserves": "reserved", "Tous droits réservés": "reserved", "TOUS DROITS RÉSERVÉS": "reserved", "OpenRAIL-M license": "rail", "Creative Commons Attribution-Non-Commercial": "cc-by-nc",
        "Creative Commons Attribution-Non-Commercial-Share-Alike": "cc-by-nc-sa", "Creative Commons Attribution-Non-Commercial-No Derivatives": "cc-by-nc-nd", "Attribution-Share Alike license": "cc-by-sa", "Attribution No Derivatives license": "cc-by-nd",
    }
    for text, label in found.items():
        assert [x[0] for x in licenses.detect(licenses.words_of(text)[1])] == [label], text


def test_near_copies_that_differ_by_a_repeated_line(spark):
    rng = random.Random(21)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows = []
    for i in range(0, 60, 2):
        body, line = fresh(200), fresh(30)
        rows += [(i, body), (i + 1, body + f"\n{line}" * 200)]
    own = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in rows)}
    assert all(5 * len(own[i] & own[i + 1]) >= 4 * len(own[i] | own[i + 1]) for i in range(0, 60, 2))
    got = {r.doc_id: r.class_id for r in neardup.op2_prob_minhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_weights_keep_the_probability_jaccard_near_that_of_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, a, b = rng.integers(20, 80), *rng.integers(0, 8, 2)
        x, y = (neardup.weights(rng.choice([1, 1, 2, 50, 10**6], n + a + b).astype(float)) for _ in "xy")
        x[n + a :], y[n : n + a] = 0, 0
        likely = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(n))
        assert likely >= n / (n + a + b) / neardup.HEAVIEST


def test_blocks_put_out_links_that_join_and_lose_none():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**62, 60).astype("<u8")
    sets = []
    for _ in range(90):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 16), replace=False)] = rng.integers(0, 2**62, 1)
        sets.append(np.unique(own))
    n = len(sets)
    link = {(i, j) for i in range(n) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}

    def parts(links):
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[root(a)] = root(b)
        return {frozenset(i for i in range(n) if root(i) == r) for r in map(root, range(n))}

    ids = np.arange(n)
    got = neardup.joining_links(ids, ids, np.full(n, 2), sets)
    assert {(max(x), min(x)) for x in got} <= link and parts(got) == parts(link) and len(got) == n - len(parts(link))
    side = (ids % 3 == 0).astype(int)
    across = {(i, j) for i, j in link if side[i] != side[j]}
    assert parts(neardup.joining_links(ids, ids, side, sets)) == parts(across)


def test_large_clusters_give_the_same_classes(spark, docs, monkeypatch):
    rng = random.Random(33)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 9)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.class_id for r in neardup.op2_prob_minhash(d).collect()}
    monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    assert {r.doc_id: r.class_id for r in neardup.op2_prob_minhash(d).collect()} == whole and len(set(whole.values())) > 1


def test_every_shared_passage_holds_a_unit_wherever_it_stands():
    rng = random.Random(13)
    least = substrings.PASSAGE_WORDS + 2 * substrings.WINDOW - 1
    assert least <= 51
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    for kinds in (10**9, 10, 2, 1):
        for _ in range(300):
            few = [f"v{rng.randrange(10**9)}" for _ in range(min(kinds, least))]
            passage = few if kinds > least else [rng.choice(few) for _ in range(least)]
            wrapped = "\n".join(" ".join(passage[i : i + 7]) for i in range(0, least, 7))
            a = substrings.units(pa.array([f"{fresh(rng.randrange(30))} {' '.join(passage)} {fresh(rng.randrange(30))}"]))
            b = substrings.units(pa.array(["other", f"{fresh(rng.randrange(30))} {wrapped} {fresh(rng.randrange(30))}"]))
            assert set(zip(a[3], a[4])) & set(zip(b[3], b[4])), passage


def test_added_personal_data_needs_checks_and_context(spark):
    dni = lambda n: f"{n}{'TRWAGMYFPDXBNJZSQVHLCKE'[n % 23]}"
    cases = {
        "iban GB82 WEST 1234 5698 7654 32 ok": ["iban"], "iban GB83 WEST 1234 5698 7654 32 bad": [], "ssn 219-09-9999": ["ssn"], "part 219-09-9999": [], "ssn 000-12-3456": [],
        f"DNI {dni(12345678)}": ["dni"], f"x {dni(12345678)[:-1]}A": [], "mac 00:1A:2b:3c:4d:5e.": ["mac"], "00:00:00:00:00:00": [], "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334": ["ipv6"],
        "routing 021000021": ["route"], "number 021000021": [], "routing 021000022": [], 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"': ["secret"], 'commit "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"': [], "token aaaaaaaaaaaaaaaaaaaaaaaaaaaa": [], f'token = "{"f3ef4d6b2755a36d" * 200}"': ["secret"],
    }
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").withColumn("__gaps_email", F.lit(1))
    found = pii.find(d)
    assert "__gaps_email" in found.columns
    for r in found.collect():
        assert [x.kind for x in r.pii] == cases[r.text], r.text
        assert all(0 < x.score <= 1 for x in r.pii)
    many = "é " + " ".join(f"a{i}@b.com +4912345678{i % 10}" for i in range(3000)) + " end"
    r = pii.redact(pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string"))).first()
    assert r.text == "é " + " ".join("[EMAIL] [PHONE]" for _ in range(3000)) + " end"
    assert pii.redact(pii.find(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).count() == 2


def test_components_end_with_stars(spark, monkeypatch):
    """Stars about their smallest node take no round; what isn't one takes some; each edge table is written once."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(0) or cut(df))
    find = lambda edges: {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert find([(1, i) for i in range(2, 40)] + [(50, 51), (7, 7)]) == {i: 1 for i in range(1, 40)} | {50: 50, 51: 50}
    assert len(written) == 1
    assert find([(i, i + 1) for i in range(30)]) == {i: 0 for i in range(31)} and len(written) > 2
    assert find([(99, i) for i in range(20)]) == {i: 0 for i in [*range(20), 99]} and find([]) == {}


def test_quality_bands_learn_from_all_labelled_documents(spark):
    """The good documents with the largest hashes are of another kind; 4000 of each class were learnt from."""
    order = [r.id for r in spark.range(6500).where("crc32(cast(cast(id as string) as binary)) % 5 != 0").orderBy(F.xxhash64("id")).collect()]
    late, rng = set(order[4000:]), random.Random(3)
    text = lambda i: " ".join("%012x" % rng.getrandbits(2**4 * 3) if i in late else rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(60 + i % 90))
    d = spark.createDataFrame([(i, text(i)) for i in order], "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, 1, 0) for i in order], "doc_id long, quality int, toxic int")
    assert len(late) > 500
    got = quality.op8_compression_bands(d, lab).where("not base_failed")
    assert got.where("not kept").count() == 0 < got.count()
