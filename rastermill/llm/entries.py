"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, language_id, main_text, minhash, packing, pii, quality, repetition, substring_dedup, suffix_tree, token_counts, warc
from .common import table


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the unigram rules over a public vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_warc": warc.op4_warc,
    "op5_quality": quality.op5_quality,
    "op6_minhash": minhash.op6_minhash,
    "op7_suffix_tree": suffix_tree.op7_suffix_tree,
    "op8_pii": pii.op8_pii,
    "op9_packing": op9_packing,
    "op10_language_id": language_id.op10_language_id,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_periodic_runs": repetition.op12_periodic_runs,
    "op13_main_text": main_text.op13_main_text,
}
ORACLES = {"op4_warc": warc.ORACLE, "op5_quality": quality.KEPT_SQL, "op11_hard_negatives": hard_negatives.ORACLE}
