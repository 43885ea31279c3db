"""Streams of messages and pages: running token sums, and references as pages arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.functions import scalar as s
from docspark.operators import extract


def message_stream(spark: SparkSession, path: str, schema: str = "conv_id long, turn long, role string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_tokens(messages: DataFrame) -> DataFrame:
    """Tokens and user messages of each conversation so far, for update or complete mode."""
    return messages.where("role <> 'summary'").groupBy("conv_id").agg(F.sum(s.token_estimate(F.col("text"))).alias("tokens"), F.count_if(F.col("role") == "user").alias("user_messages"))


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def extract_stream(sources: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """References of each arriving batch of ``sources(doc_id, source_ord, text)``; documents arrive whole, so no state is kept."""
    return sources.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: sink(extract.references(batch), number)).start()
