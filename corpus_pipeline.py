"""The corpus pipeline: stages of training-data operators over documents, each reading what the one before wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import neardup, packing, pii, substrings, toxicity
from tapeworks.llm.shared import free_name, use_shared_folder

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model predicts 0 for; it learns from the labels of documents outside its fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, then text digest; those without an id rank last.

    Rows of one id are told apart by their texts; of rows with the same id and text one stays.
    """
    digest, key, first = free_name(docs, "__digest", "__key", "__first")
    kept = neardup.representatives(docs.select("doc_id", "text")).select(F.col("key").alias(key), F.col("doc").alias(first))
    own = docs.withColumn(digest, neardup.digest("text"))
    same = (own[digest] == kept[key]) & own.doc_id.cast("long").eqNullSafe(kept[first])
    return own.join(kept, same, "left_semi").dropDuplicates([digest]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines and passages that an earlier one has; a document that was nothing else goes."""
    out = substrings.dedupe(docs)
    nothing_left = (F.size("removed") > 0) & ~out.text.rlike(r"[^\x20\x09-\x0D]")
    return out.where(~nothing_left).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the names of their kinds."""
    out = pii.redact(pii.find(docs))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeats", cut_repeats), ("personal data", redact), ("packing", pack)]

#: The stages hold models and hashes that SQL can't express; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{use_shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
