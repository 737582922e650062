"""The pipeline's stages on a small table with cases planted in it."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import DATA
from tests.llm.test_operators import sentence


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(400):
        w = sentence(rng, rng.randrange(60, 120)).split()
        toxic = i % 4 == 0
        for _ in range(5 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "numbskull", "nitwit"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    near = docs[1][1].split()
    docs += [(500, docs[1][1]), (501, " ".join([*near[:-1], "changed"])), (502, sentence(rng, 60) + " write to a@b.com or 4111 1111 1111 1111"), (503, None)]
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = cp.drop_toxic(spark, docs, planted)
    assert clean.columns == docs.columns
    gone = ids(docs) - ids(clean)
    toxic = {i for i in range(0, 400, 4)}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 8
    single = cp.drop_near_copies(spark, clean, planted)
    assert ids(clean) - ids(single) == {500, 501} and single.columns == docs.columns
    cut = cp.cut_repeats(spark, single, planted)
    assert cut.columns == docs.columns and ids(cut) == ids(single)
    hidden = cp.redact(spark, cut, planted).where("doc_id = 502").first()
    assert hidden.text.endswith("[EMAIL] or [CARD]") and hidden.n_chars == len(hidden.text)


def test_run(spark):
    out = cp.run(spark, DATA).toPandas()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near copies", "repeats", "personal data", "packing"]
    assert (out.groupby("sequence_id").length.sum() <= 4096).all() and out.doc_id.nunique() > 100


def test_one_document_of_each_class_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c, d, e = (sentence(rng, 100) for _ in range(5))
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(3, b), (5, a), (5, near), (None, c), (None, c), (None, near), (7, d), (7, d), (7, e), (None, e + " more")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    for n in (1, 7):
        got = cp.drop_near_copies(spark, docs.repartition(n), "")
        assert got.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(3, b), (5, a), (0, c), (7, d), (7, e)])


def test_stages_equal_brute_force(spark, planted):
    """Each stage on what the one before has kept, against plain Python."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tapeworks.llm import toxicity
    from tests.llm.test_operators import base_spans, brute_repeats, words

    docs = spark.read.parquet(f"{planted}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{planted}/labels.parquet"))
    clean = cp.drop_toxic(spark, docs, planted)
    import pyarrow as pa

    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = dict(zip(texts, model.score(pa.array(list(texts.values()), pa.string()))))
    assert {r.doc_id for r in clean.collect()} == {i for i, x in scores.items() if x < 0.5}
    single = cp.drop_near_copies(spark, clean, planted)
    own = {r.doc_id: r.text for r in clean.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in ((i, words(t)) for i, t in own.items())}
    link = {i: {j for j in own if own[j] == own[i] or (sets[j] != {()} and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))} for i in own}
    stay, seen = set(), set()
    for i in sorted(own):
        if i not in seen:
            stay.add(i)
            reach, todo = {i}, [i]
            while todo:
                todo += (new := link[todo.pop()] - reach)
                reach |= new
            seen |= reach
    assert {r.doc_id for r in single.collect()} == stay
    line = "a line of more than eight words that many documents of a corpus share"
    shared = single.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n" + line))).when(F.col("doc_id") == 7, F.lit(line)).otherwise(F.col("text")))
    shared = shared.withColumn("n_chars", F.length("text").cast("long"))
    left = {r.doc_id: r for r in cp.cut_repeats(spark, shared, planted).collect()}
    for i, gone in brute_repeats([(r.doc_id, r.text) for r in shared.collect()]).items():
        raw = np.frombuffer(i[1].encode(), np.uint8)
        if gone.any() and not raw[~gone].tobytes().strip():
            assert i[0] not in left
        else:
            assert left[i[0]].text.split() == raw[~gone].tobytes().decode().split() and left[i[0]].n_chars == len(left[i[0]].text)
    hidden = {r.doc_id: r.text for r in cp.redact(spark, single, planted).collect()}
    for r in single.collect():
        t, at = r.text or "", 0
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in base_spans(r.text))
        out = ""
        for a, b, k in spans:
            if a >= at:
                out += t[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert (hidden[r.doc_id] or "") == out + t[at:]
    pieces = cp.pack(spark, single, planted).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    for r in single.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for x in pieces[pieces.doc_id == r.doc_id].itertuples():
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
        assert pieces[pieces.doc_id == r.doc_id].length.sum() == len(ids)


def test_stages_of_empty_tables_nulls_ties_and_very_long_texts(spark, planted):
    rng = random.Random(4)
    long = sentence(rng, 60_000)
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (None, None), (9, "tie"), (10, "tie"), (11, "pad " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), planted).count() == 0, name
        out = stage(spark, kept, planted)
        if name == "near copies":
            assert sorted(r.doc_id for r in out.collect()) == [1, 3, 9, 11]
        if name != "packing":
            assert out.columns == docs.columns
            kept = out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {1, 3, 9, 11}
