"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import audit, bpe, kneserney, licenses, neardup, packing, pii, quality, resampling, simhash, substrings, topk, toxicity
from tapeworks.llm.shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.op5_byte_bpe(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_topk": lambda s, d: topk.op1_pivot_topk(table(s, d, "embeddings")),
        "op2_prob_minhash": lambda s, d: neardup.op2_prob_minhash(table(s, d, "documents")),
        "op3_kneser_ney": lambda s, d: kneserney.op3_kneser_ney(table(s, d, "documents")),
        "op4_packing": lambda s, d: packing.op4_packing(table(s, d, "documents"), _vocabulary("word_bpe_49k.json")),
        "op5_byte_bpe": _byte_bpe,
        "op6_line_hashes": lambda s, d: substrings.op6_line_hashes(table(s, d, "documents")),
        "op7_pii": lambda s, d: pii.op7_pii(table(s, d, "documents")),
        "op8_compression_bands": lambda s, d: quality.op8_compression_bands(table(s, d, "documents"), table(s, d, "labels")),
        "op9_toxicity": lambda s, d: toxicity.op9_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op10_license_rules": lambda s, d: licenses.op10_license_rules(table(s, d, "documents")),
        "op11_importance_resampling": lambda s, d: resampling.op11_importance_resampling(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_filter_audit": lambda s, d: audit.op12_filter_audit(table(s, d, "documents"), table(s, d, "labels")),
        "op13_simhash_anchors": lambda s, d: simhash.op13_simhash_anchors(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": topk.ORACLE_SQL, "op11_importance_resampling": resampling.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL}
