"""Keeps the search index of a growing table of documents.

    python -m jobs.index_documents --config jobs/index_documents.json \
        --documents <folder> --output <folder> --checkpoint <folder>

The documents' files are a stream: each run takes the files that its checkpoint hasn't
seen, in batches of at most ``max_files`` files, and ends when there are no more. A
batch writes

    <output>/postings/lang=../batch=..   doc_id, term, tf
    <output>/lengths/lang=../batch=..    doc_id, len

and overwrites only its own folders, so a batch that is run again after a failure
writes what it wrote before. A document that is sent again, in a later file of a batch
or a later batch, replaces what it was: a reader takes each document's last batch
(``postings``, ``index``). A document whose new text has no words stays in ``lengths``,
so that its old postings go.

Rows without an id can't be looked up and aren't indexed; the log says how many. A null
language is a folder of its own. Extra columns are ignored.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from quillgraph.functions import text as T
from quillgraph.operators import bm25, upsert

PATHS = ("documents", "output", "checkpoint")
DEFAULTS = {"id": "doc_id", "text": "text", "lang": "lang", "max_files": 1000, "rows_per_file": 2_000_000}
POSTINGS = "doc_id long, term string, tf long, lang string, batch long"
LENGTHS = "doc_id long, len long, lang string, batch long"


def write_batch(batch: DataFrame, number: int, output: str, config: dict) -> None:
    sent, read = counted(batch, "read", F.count_if(F.col("doc_id").isNull()).alias("without_id"))
    # of a document's rows the one of the youngest file; of one file's the greatest text
    last = upsert.latest_by_key(sent.where("doc_id is not null").withColumn("at", F.struct("written_at", "file", "text")), ["doc_id"], "at")
    docs = last.select("doc_id", "lang", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens")).persist()
    try:
        words = docs.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).head()[0]
        files = max(1, -(-words // config["rows_per_file"]))  # a small batch is few files, not one a task
        lengths, n_docs = counted(docs.select("doc_id", "lang", F.size("tokens").cast("long").alias("len")), "documents")
        terms = docs.select("doc_id", "lang", F.explode("tokens").alias("term")).groupBy("lang", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        postings, n_postings = counted(terms, "postings")
        for rows, name in ((lengths, "lengths"), (postings, "postings")):
            own = rows.withColumn("batch", F.lit(number).cast("long"))
            own.coalesce(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "batch").parquet(f"{output}/{name}")
        log.info("batch %d: read %d rows, %d without an id; wrote %d documents, %d postings", number, read.get["rows"], read.get["without_id"], n_docs.get["rows"], n_postings.get["rows"])
    finally:
        docs.unpersist()


def followed(documents: str, files: list[str]) -> str:
    """The path to stream. A stream takes a path for the folder that partitions are
    under; a table of one file has none, and is followed as a pattern of that one name."""
    folder, _, name = documents.rstrip("/").rpartition("/")
    return f"{folder}/[{name[0]}]{name[1:]}" if len(files) == 1 and files[0].endswith(f"/{name}") else documents


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes what is new; gives the number of batches and rows that this run read."""
    config = DEFAULTS | (config or {})
    now = spark.read.parquet(documents)
    rows = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", config["max_files"]).parquet(followed(documents, now.inputFiles()))
    rows = rows.select(
        F.col(config["id"]).cast("long").alias("doc_id"),
        F.col(config["text"]).cast("string").alias("text"),
        F.col(config["lang"]).cast("string").alias("lang"),
        F.col("_metadata.file_modification_time").alias("written_at"),
        F.col("_metadata.file_path").alias("file"),
    )
    writer = rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, output, config))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    done = {"batches": len(batches), "rows": sum(p["numInputRows"] for p in batches)}
    log.info("%s: %d new rows in %d batches; index in %s", documents, done["rows"], done["batches"], output)
    return done


def last_batches(spark: SparkSession, output: str) -> DataFrame:
    """doc_id, len, lang, batch: what each document is now."""
    return upsert.latest_by_key(spark.read.schema(LENGTHS).parquet(f"{output}/lengths"), ["doc_id"], "batch")


def postings(spark: SparkSession, output: str) -> DataFrame:
    """lang, doc_id, term, tf of the documents as they are now."""
    rows = spark.read.schema(POSTINGS).parquet(f"{output}/postings")
    return rows.join(last_batches(spark, output).select("doc_id", "batch"), ["doc_id", "batch"]).select("lang", "doc_id", "term", "tf")


def index(spark: SparkSession, output: str, lang: str) -> bm25.Index:
    """What ``bm25.search`` takes, of one language."""
    own = postings(spark, output).where(F.col("lang") == lang).select("term", "doc_id", "tf")
    docs = last_batches(spark, output).where((F.col("lang") == lang) & (F.col("len") > 0)).select("doc_id", "len")
    terms = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return bm25.Index(terms, docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")), stored=(own, docs))


if __name__ == "__main__":
    main(run, PATHS, DEFAULTS, sys.argv[1:])
