"""Structured Streaming into the batch plans (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "doc_id long, text string, source string, arrived timestamp"


def documents(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """New Parquet files of documents; a text that comes again within ``late`` is dropped."""
    stream = spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("arrived", late)
    return stream.withColumn("sha", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["sha"]).drop("sha")


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Put every micro-batch through a batch plan; a batch that runs again replaces its own output."""

    def step(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
