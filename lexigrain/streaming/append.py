"""Streaming of new documents into token tables (beyond parity: the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrain.plans.corpus import words_of


def append_tokens(spark: SparkSession, documents: str, tokens: str, checkpoint: str, schema) -> StreamingQuery:
    """Tokens of every document file that arrives under ``documents``; each batch is written once, whatever restarts."""
    rows = spark.readStream.schema(schema).parquet(documents)
    found = rows.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return found.writeStream.format("parquet").option("path", tokens).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
