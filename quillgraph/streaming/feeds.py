"""A feed of documents that became ready, and workers that follow it.

The ingestor appends to ``feed/documents`` the documents that a batch gave their first
text (a document is chunked once, as by the polling workers, which look for documents
that have no chunks). A worker is a stream over the feed: its checkpoint says which files
it has taken, so what a batch reads is what is new, however large the tables are, and
what it writes is a folder of its own, ``<output>/batch=n``, not buckets of all that is
there. A batch that is run again, by the ingestor or a worker, writes its folder again;
readers (``held``) take the last row of a key, so a document that is fed twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunk, upsert

FEED = "id string, contentAr string, contentEn string, batch long"
CHUNKS = "id string, doc_id string, language string, index long, text string"
ERRORS = "doc_id string, problem string"
LINKS = "doc_id string, name string"


def publish(tables, nodes: DataFrame, number: int) -> None:
    """Appends the documents that this batch (``nodes``, already merged as version
    ``number``) gave text and that had none. Reads the buckets of the batch's keys."""
    ids = nodes.select("id").distinct().persist()
    ready = T.has_text(F.col("contentAr")) | T.has_text(F.col("contentEn"))
    now, before = tables.of("documents", ids, ["id"]), tables.of("documents", ids, ["id"], number)
    if now is not None:
        new = now.where(ready) if before is None else now.where(ready).join(before.where(ready).select("id"), "id", "left_anti")
        new.select("id", "contentAr", "contentEn").write.mode("overwrite").parquet(f"{tables.root}/feed/documents/batch={number}")
    ids.unpersist()


def follow_feed(spark: SparkSession, root: str, name: str, work: Callable[[DataFrame, int], None], once: bool = True, max_files: int = 100) -> StreamingQuery:
    """Streams the feed to ``work(rows, number)``, at most ``max_files`` files a batch;
    ``once`` stops when what is there is done. Each follower has a name, and a checkpoint."""

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # read once, however often the work looks at it
        try:
            work(rows, number)
        finally:
            rows.unpersist()

    rows = spark.readStream.schema(FEED).option("maxFilesPerTrigger", max_files).parquet(f"{root}/feed/documents").drop("batch")
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/_{name}_stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def put(rows: DataFrame, root: str, name: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/feed/{name}/batch={number}")


def held(spark: SparkSession, root: str, name: str, schema: str, keys: list[str]) -> DataFrame:
    """What a follower has written, the last row of each key."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/feed/{name}")
    return upsert.latest_by_key(rows, keys, "batch").drop("batch")


def chunk_stream(spark: SparkSession, root: str, once: bool = True, size: int = 510, overlap: int = 50, embed: Callable[[Column], Column] | None = None, max_files: int = 100) -> StreamingQuery:
    """The chunk worker: chunks of new documents to ``feed/chunks``, with vectors where
    there is a function for them; those that can't be split to ``feed/chunk_errors``."""

    def work(rows: DataFrame, number: int) -> None:
        new = chunk.chunks(rows, size, overlap, id_col="id", keep_problems=True).persist()
        good = new.where("problem is null").drop("problem")
        put(good.withColumn("embedding", embed(F.col("text"))) if embed else good, root, "chunks", number)
        put(new.where("problem is not null").select("doc_id", "problem"), root, "chunk_errors", number)
        new.unpersist()

    return follow_feed(spark, root, "chunk", work, once, max_files)


def topic_stream(spark: SparkSession, root: str, tables, name_topics: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column], once: bool = True, max_files: int = 100) -> StreamingQuery:
    """The topic worker: links of new documents to ``feed/has_topic``; names that have
    no vector yet get one, in the keyed table ``topics``, of which only the names'
    buckets are read."""

    def work(rows: DataFrame, number: int) -> None:
        texts = rows.select(F.col("id").alias("doc_id"), T.topic_source(F.col("contentAr"), F.col("contentEn")).alias("text"))
        pairs = name_topics(texts).select("doc_id", F.explode("topics").alias("name")).distinct().persist()
        names = pairs.select("name").distinct()
        known = tables.of("topics", names, ["name"], number)
        new = names if known is None else names.join(known.where("embedding is not null").select("name"), "name", "left_anti")
        merge = lambda old, rows: upsert.merge(old, rows, ["name"])
        tables.write("topics", number, new.select("name", embed(F.col("name")).alias("embedding"), F.lit(number).cast("long").alias("seq")), ["name"], merge)
        put(pairs, root, "has_topic", number)
        pairs.unpersist()

    return follow_feed(spark, root, "topic", work, once, max_files)
