"""A corpus pipeline: quality, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, packing, quality, store, substring

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more.

    The labels of documents that are no longer here, or none at all, are no
    obstacle: see ``quality.trained``.  Null and empty texts are scored as texts
    without words.
    """
    model = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, "quality_score_").filter("quality_score_ >= 0.5").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates.

    Documents without words are in no group and stay.  Rows with equal id and
    equal text are one document; different texts that share an id, or have none,
    are documents of their own.  A document without an id comes after all others
    of its group.
    """
    key, least = F.xxhash64("doc_id", "text"), F.lit(-(1 << 63))
    groups = jaccard.join(docs.select(key.alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    groups = groups.select(F.coalesce("doc_id", least).alias("key_"), F.coalesce("component_id", least).alias("group_"))
    ids = docs.select(key.alias("key_"), "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key_")
    first = groups.distinct().join(ids, "key_").groupBy("group_").agg(F.min(order)["key_"].alias("first_"))
    kept = docs.join(first, key == F.col("first_"), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words or more that start earlier.

    A text that loses nothing stays as it is; one that loses all is empty and
    keeps its row.  ``n_chars`` follows the text.
    """
    out = substring.deduplicated(docs, texts=True)
    if "n_chars" in docs.columns:
        changed = F.col("n_removed") > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("repeated_passages", unrepeated), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.written(docs, name)
    return docs
