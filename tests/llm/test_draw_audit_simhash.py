"""Operators 11 to 13 against brute force, with nulls, ties, repeats, very long texts, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeworks.llm import audit, resampling, simhash

VOCABULARY = "Alpha beta gamma Delta epsilon zeta été théta iota kappa 42 x9 λόγος".split()


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", ",", "-s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "One", "two words", "A b\x0bc\x0cd\re", "!?", "naïve 日本 ☃", "x" * 5000, "SHOUT LOUD " * 40, "word " * 300]
    texts += [prose(rng, n) for n in (19, 20, 21, 49, 50, 51, 200, 900)]
    for n in (60, 400):  # near and exact copies
        t = prose(rng, n).split(" ")
        texts += [" ".join(t), " ".join(t), " ".join(t[:-1]), " ".join([*t, "end"]), " ".join(t[: n // 2] + ["new"] + t[n // 2 :])]
    texts += [f"{prose(rng, 70)} {c}" for c in "#$%&*|"]
    texts += [prose(rng, 40_000)]
    out = [(7 * i % 101, t, ["a", "b", None, ""][i % 4]) for i, t in enumerate(texts)]
    out += [out[12], out[13], (out[14][0], "another text of the same id", "b"), (None, texts[19], "a"), (None, texts[19], "b"), (None, "alone", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows, with columns whose names clash with results."""
    schema = "doc_id long, text string, source string, score string, RANK int, mask string, fp string, n long"
    return spark.createDataFrame([(*r, "s", 1, "m", "f", 5) for r in rows], schema).repartition(3)


def test_resampling_equals_brute_force(spark, docs, rows):
    texts = ["alpha beta gamma beta", "Kappa kappa, iota!", None, "", "Alpha " * 50]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for run, n_buckets, percent in ((1, 10_000, 10), (2, 97, 35)):
        grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]  # noqa: E731, B023
        count = lambda ts: Counter(zlib.crc32(g.encode()) % n_buckets for t in ts for g in grams(words(t)))  # noqa: E731, B023
        s, t = count([r[1] for r in rows]), count(texts)
        gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + n_buckets) / ((s[b] + 1) * (sum(t.values()) + n_buckets)))) for b in s}
        want = []
        for doc, text, _ in rows:
            g = [gain[zlib.crc32(x.encode()) % n_buckets] for x in grams(words(text))]
            h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
            weight = sum(g) // len(g) if g else 0
            want.append((doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))))
        drawn = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
        drawn = drawn[: percent * len(drawn) // 100]
        got = [tuple(r) for r in resampling.resample(docs, target, run=run, n_buckets=n_buckets, percent=percent).collect()]
        assert Counter(x[:4] for x in got) == Counter(x[:4] for x in want)
        assert [x[:4] for x in sorted((x for x in got if x[4]), key=lambda x: x[4])] == [x[:4] for x in drawn]
        assert sorted(x[4] for x in got if x[4]) == list(range(1, len(drawn) + 1))
    none = docs.where("false")
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(docs, target.where("false")).where("rank is not null").count() == len([x for x in rows if len(words(x[1])) >= 20]) // 10
    assert dict(resampling.resample(docs, target).dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")


def test_pieces_of_long_texts_part_between_words():
    text = prose(random.Random(2), 3000)
    for limit in (7, 100, 10**6):
        assert "".join(resampling.pieces(text, limit)) == text
        split = resampling._splitter()
        assert [w for p in resampling.pieces(text, limit) for w, _ in split(p)] == [w for w, _ in split(text)]
    assert list(resampling.pieces("w" * 50, 7)) == ["w" * 50] and list(resampling.pieces("")) == []


def test_audit_equals_brute_force(spark, docs, rows):
    said = [(7, 1, 1), (14, 1, 0), (14, 0, 1), (0, None, 1), (None, 1, 1), (77, 1, 0), (84, 0, 1), (91, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    good, toxic = ({d for d, q, t in said if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for doc, text, _ in rows:
        least[text or ""] = min(least.get(text or "", math.inf), math.inf if doc is None else doc)
    failed = []
    for doc, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = (math.inf if doc is None else doc) > least[t]
        failed.append((part or "", {k for k, x in own.items() if x}, doc in good, doc in toxic))
    want = {}
    for part in {x[0] for x in failed}:
        mine, total = [x[1:] for x in failed if x[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for i, c in enumerate(order):
                out = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                total[c] += len(out)
                redundant = sum(c in x[0] and bool(x[0] & set(order[:i])) for x in mine)
                want[part, "".join(order), i + 1] = [len(left), len(out), redundant, sum(x[0] == {c} for x in mine), sum(x[1] for x in out), sum(x[2] for x in out), c]
        for k in [k for k in want if k[0] == part]:
            want[k][-1] = total[want[k][-1]]
    got = audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == want
    assert audit.audit(docs, labels.where("false")).agg(F.max("good_lost")).first()[0] == 0
    assert audit.audit(docs.where("false"), labels).count() == 0


def test_packed_counters_hold_large_counts():
    n = 2**62
    total = audit.packed(0b00011) * n + audit.packed(0b10000) * (n - 1)
    counts = audit.unpacked(total)
    assert len(counts) == 600 and len(audit.steps()) == 600
    for (order, step, bit, before), row in zip(audit.steps(), counts.tolist()):
        masks = {0b00011: n, 0b10000: n - 1}
        assert row[0] == sum(k for m, k in masks.items() if not m & (before | bit)), (order, step)
        assert row[1] == sum(k for m, k in masks.items() if m & bit and not m & before)
        assert row[2] == sum(k for m, k in masks.items() if m & bit and m & before)
        assert row[3] == masks.get(bit, 0)


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force(monkeypatch, rows):
    texts = [r[1] or "" for r in rows if len(r[1] or "") < 20_000]
    want = [brute_print(t) for t in texts]
    assert simhash.fingerprints(texts).tolist() == want
    monkeypatch.setattr(simhash, "PIECE", 7)  # pieces of long texts
    assert simhash.fingerprints(texts).tolist() == want


def components(prints, threshold):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= threshold:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_components_equal_brute_force(docs, rows):
    prints = [brute_print(t) for _, t, _ in rows]
    of = components(sorted(set(prints)), 2)
    least = {}
    for (doc, _, _), p in zip(rows, prints):
        least[of[p]] = min(least.get(of[p], math.inf), math.inf if doc is None else doc)
    want = Counter((doc, f"{p:016x}", None if least[of[p]] == math.inf else least[of[p]]) for (doc, _, _), p in zip(rows, prints))
    assert Counter(tuple(r) for r in simhash.op13_simhash_anchors(docs).collect()) == want
    assert simhash.op13_simhash_anchors(docs.where("false")).count() == 0


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_anchors_lose_no_link(spark, monkeypatch, threshold):
    """Random fingerprints with planted neighbours up to four bits away, and a whole ball around one; blocks of few rows."""
    rng = np.random.default_rng(threshold)
    prints = rng.integers(0, 2**64, 150, dtype=np.uint64)
    for flips in (1, 2, 3, 4):
        near = prints[:60].copy()
        for row in range(len(near)):
            for i in rng.choice(64, flips, replace=False):
                near[row] ^= np.uint64(1) << np.uint64(i)
        prints = np.concatenate([prints, near])
    ball = [prints[0] ^ np.uint64((1 << int(i)) | (1 << int(j))) for i, j in rng.integers(0, 64, (120, 2))]
    prints = np.unique(np.concatenate([prints, np.array(ball, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 500)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long").repartition(3)
    got = {}
    for r in simhash.links(df, threshold).collect():
        a, b = (x & 2**64 - 1 for x in r)
        assert (a ^ b).bit_count() <= threshold
        got.setdefault(a, set()).add(b)
        got.setdefault(b, set()).add(a)
    want = components([int(p) for p in prints], threshold)
    label = {}
    for p in want:
        if p not in label:
            todo = [p]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = p
                    todo += got.get(x, ())
    assert len(set(label.values())) == len(set(want.values()))
    assert len({(label[p], want[p]) for p in want}) == len(set(want.values()))


def test_every_fingerprint_has_an_anchor_within_the_radius():
    table = simhash.patterns(2)
    assert sorted(len(t) for t in table) == [2] + [33] * 63
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    for s, own in zip(simhash.syndromes(x).tolist(), x):
        anchors = own ^ table[s]
        assert not simhash.syndromes(anchors).any()
        assert np.bitwise_count(anchors ^ own).min() <= simhash.RADIUS and np.bitwise_count(anchors ^ own).max() <= 2
