"""The operators' queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, fingerprints, jaccard, neardup, packing, quality, sharding, substring, token_store, warc
from quire.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_quality": quality.query,
    "op2_token_store": token_store.query,
    "op3_histogram_sort": sharding.query,
    "op4_pstable_neardup": neardup.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_recursive_bpe": bpe.query,
    "op7_invertible_sketch": fingerprints.query,
    "op8_substring_dedup": substring.query,
    "op9_warc_segments": warc.query,
    "op10_pattern_packing": packing.query,
}
