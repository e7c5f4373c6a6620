"""Sinks: one JSON file set per run, event queues, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept, nulls written, laid out by status."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("status").json(path)


def push_events(events: DataFrame, path: str) -> None:
    """Appends envelopes (seq, json) to a queue folder that ``event_stream`` reads."""
    events.select("seq", "json").write.mode("append").json(path)


def queue_length(spark, path: str) -> int:
    return spark.read.schema("seq long, json string").json(path).count()


def clear_queue(spark, path: str) -> None:
    spark.createDataFrame([], "seq long, json string").write.mode("overwrite").json(path)


def persist_communities(groups: DataFrame, members: DataFrame, label, path: str) -> None:
    """communities(community, label) and belongs_to(kind, key, community)."""
    groups.select("community", label(F.col("community")).alias("label")).write.mode("overwrite").parquet(f"{path}/communities")
    members.write.mode("overwrite").parquet(f"{path}/belongs_to")
