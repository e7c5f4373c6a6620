"""Long-lived workers: a Structured Streaming ingestor and polling workers.

At least once and idempotent: what a batch changes is merged by key into its tables,
and the batch's number names what it wrote, so a batch that is run again writes what
it wrote before. What can't be read or split goes to tables of its own.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunk, upsert
from ..sources.inputs import event_stream
from . import feeds

BUCKETS = 64

log = logging.getLogger(__name__)


class Tables:
    """Keyed tables in a folder, in buckets by key.

    A version n writes the buckets that it changes to name/v=n and a manifest,
    name/_manifest/n.json, of the version that holds each bucket. So a change costs the
    buckets that it touches. ``vacuum`` deletes what no kept manifest names; a write does
    so once in ``keep`` versions, so that a table's files are those of at most twice as
    many. A reader of a version that old has to read again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, keep: int = 16):
        self.spark, self.root, self.buckets, self.keep = spark, root, buckets, keep
        jvm = spark._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        folder = self.path_of(f"{self.root}/{name}/_manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(p.getPath().getName().removesuffix(".json")) for p in self.fs.listStatus(folder) if p.getPath().getName().endswith(".json"))

    def next(self, name: str) -> int:
        return max(self.versions(name), default=-1) + 1

    def manifest(self, name: str, before: int | None = None) -> dict[int, int]:
        """The version of each bucket, as of the latest version (before ``before``)."""
        found = [v for v in self.versions(name) if before is None or v < before]
        if not found:
            return {}
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/{name}/_manifest/{found[-1]}.json").collect())  # a number a bucket
        return {int(b): v for b, v in json.loads(text).items()}

    def read(self, name: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        held = self.manifest(name, before)
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def of(self, name: str, rows: DataFrame, keys: list[str], before: int | None = None) -> DataFrame | None:
        """The table's rows that have a key of ``rows``: only the buckets of these are read."""
        touched = [r.b for r in rows.select(self.bucket(keys).alias("b")).distinct().collect()]  # a number a bucket
        held = self.read(name, before, touched)
        return None if held is None else held.join(rows.select(*keys).distinct(), keys, "left_semi")

    def write(self, name: str, version: int, changes: DataFrame, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Merges the changes into the buckets of their keys: ``merge(old, changes)``."""
        bucket = self.bucket(keys)
        changes = changes.persist()
        try:
            touched = [r.b for r in changes.select(bucket.alias("b")).distinct().collect()]  # a number a bucket
            if touched:
                held = self.manifest(name, version)
                new = merge(self.read(name, version, touched), changes)
                new.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/v={version}")
                self.put(f"{self.root}/{name}/_manifest/{version}.json", json.dumps(held | dict.fromkeys(touched, version)))
                if self.keep and version % self.keep == self.keep - 1:
                    self.vacuum(name, self.keep)
        finally:
            changes.unpersist()

    def publish(self, name: str, version: int, changes: DataFrame, keys: list[str], order: str = "seq") -> dict:
        """``write`` under the constraint that keys are there and unique: one row a key
        is published, what breaks the constraint goes to ``<name>_violations`` first.
        Gives the numbers of rows, of rows without a key, of published ones and of keys
        with several rows; the log has them too."""
        changes = changes.persist()
        try:
            good, bad, seen = upsert.checked(changes, keys, order)
            at = F.lit(version).cast("long")
            bad = bad.select(F.to_json(F.struct(*keys)).alias("key"), at.alias("version"), "reason", "rows", at.alias("seq"))
            self.write(f"{name}_violations", version, bad, ["key", "version"], latest(["key", "version"]))
            self.write(name, version, good, keys, latest(keys))
            counts = dict(seen.get)
        finally:
            changes.unpersist()
        log.info("%s, version %d: %s", name, version, counts)
        return counts

    def put(self, path: str, text: str) -> None:
        """A whole file or none: written beside and renamed."""
        beside, to = self.path_of(f"{path}.tmp"), self.path_of(path)
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(to, False)
        self.fs.rename(beside, to)

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Deletes manifests but the last ``keep`` and the buckets that only they name."""
        every = self.versions(name)
        kept = every[-keep:] if keep else []
        named = {(v, b) for k in kept for b, v in self.manifest(name, k + 1).items()}
        for v in every:
            folder = self.path_of(f"{self.root}/{name}/v={v}")
            if self.fs.exists(folder):
                own = [p.getPath() for p in self.fs.listStatus(folder) if p.getPath().getName().startswith("bucket=")]
                gone = [p for p in own if (v, int(p.getName().partition("=")[2])) not in named]
                for p in [folder] if len(gone) == len(own) else gone:
                    self.fs.delete(p, True)
            if v not in kept:
                self.fs.delete(self.path_of(f"{self.root}/{name}/_manifest/{v}.json"), False)


def latest(keys: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    return lambda old, new: upsert.merge(old, new, keys)


def apply_events(tables: Tables, batch: DataFrame, number: int) -> None:
    """Merges a batch of envelopes into documents, relations and quarantine. An
    endpoint that no document has becomes a row of nothing but its id, which any
    event of that document replaces."""
    nodes, edges, bad = upsert.read_events(batch)
    tables.write("relations", number, edges, ["src", "dst"], latest(["src", "dst"]))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    stubs = ends.select("id", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c not in ("id", "seq")], F.lit(-1).cast("long").alias("seq"))
    tables.write("documents", number, nodes.unionByName(stubs), ["id"], latest(["id"]))
    tables.write("quarantine", number, bad, ["json"], latest(["json"]))
    feeds.publish(tables, nodes, number)


def ingest(spark: SparkSession, queue: str, root: str, once: bool = True, max_files: int = 1000) -> StreamingQuery:
    """Follows the queue folder, at most ``max_files`` of its files a batch; ``once`` stops
    when what is there is done. The checkpoint holds the offsets: a batch that failed is
    run again, of the same files and under the same number."""
    tables = Tables(spark, root)
    writer = event_stream(spark, queue, max_files).writeStream.foreachBatch(lambda batch, number: apply_events(tables, batch, number)).option("checkpointLocation", f"{root}/_stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def todo(tables: Tables, done: str, key: str, limit: int | None, share: float = 1.0) -> DataFrame:
    """The first documents with text that ``done`` has nothing of; of those only that the
    hashes of their ids put into the ``share`` of all."""
    docs = tables.read("documents").where(T.has_text(F.col("contentAr")) | T.has_text(F.col("contentEn")))
    old = tables.read(done)
    if share < 1:
        docs = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    left = docs if old is None else docs.join(old.select(F.col(key).alias("id")).distinct(), "id", "left_anti")
    return left.orderBy("id").limit(limit) if limit else left


def chunk_new(tables: Tables, version: int, limit: int | None = 100, **more) -> DataFrame:
    """All chunks after one poll of the chunk worker, which writes this version."""
    chunk_poll(tables, limit, version=version, **more)
    return tables.read("chunks")


def chunk_poll(tables: Tables, limit: int | None = 100, size: int = 510, overlap: int = 50, embed=None, version: int | None = None, share: float = 1.0) -> int:
    """One poll of the chunk worker: documents with text and without chunks are split
    and their chunks added, with vectors where there is a function for them (``embed``,
    of a column). A document that can't be split goes to ``chunk_errors``, with the
    reason, and is not polled again. Of the documents only a ``share`` is looked at (``todo``).
    Gives the number of documents that were taken."""
    number = lambda name: tables.next(name) if version is None else version
    rows = todo(tables, "polled", "doc_id", limit, share).persist()
    n = rows.count()
    if n:
        new = chunk.chunks(rows, size, overlap, id_col="id", keep_problems=True).persist()
        good = new.where("problem is null").drop("problem").withColumn("seq", F.lit(0).cast("long"))
        if embed is not None:
            good = good.withColumn("embedding", embed(F.col("text")))
        bad = new.where("problem is not null").select("doc_id", "problem").withColumn("seq", F.lit(0).cast("long"))
        tables.write("chunks", number("chunks"), good, ["id"], latest(["id"]))
        tables.write("chunk_errors", number("chunk_errors"), bad, ["doc_id"], latest(["doc_id"]))
        taken = rows.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("seq"))
        tables.write("polled", number("polled"), taken, ["doc_id"], latest(["doc_id"]))
        new.unpersist()
    rows.unpersist()
    return n


def topic_poll(tables: Tables, name_topics, embed, limit: int | None = 1) -> int:
    """One poll of the topic worker: documents without topics are given theirs.

    ``name_topics`` turns rows (doc_id, text) into (doc_id, topics); ``embed`` a column
    of names into vectors, of names that have none yet only. A document that gets no
    topics is marked as polled all the same. Gives the number of documents taken.
    """
    rows = todo(tables, "topic_polled", "doc_id", limit).persist()
    n = rows.count()
    if n:
        texts = rows.select(F.col("id").alias("doc_id"), T.topic_source(F.col("contentAr"), F.col("contentEn")).alias("text"))
        pairs = name_topics(texts).select("doc_id", F.explode("topics").alias("name")).distinct().persist()
        known = tables.read("topics")
        names = pairs.select("name").distinct()
        names = names if known is None else names.join(known.where("embedding is not null").select("name"), "name", "left_anti")
        seq = F.lit(0).cast("long").alias("seq")
        tables.write("topics", tables.next("topics"), names.select("name", embed(F.col("name")).alias("embedding"), seq), ["name"], latest(["name"]))
        tables.write("has_topic", tables.next("has_topic"), pairs.select("doc_id", "name", seq), ["doc_id", "name"], latest(["doc_id", "name"]))
        tables.write("topic_polled", tables.next("topic_polled"), texts.select("doc_id", seq), ["doc_id"], latest(["doc_id"]))
        pairs.unpersist()
    rows.unpersist()
    return n


def follow(poll: Callable[[], int], interval: float, once: bool = False, stop: Callable[[], bool] = lambda: False) -> int:
    """Polls until ``stop``, or until nothing is left where ``once``; waits after an
    empty poll. Gives the number of documents taken."""
    taken = 0
    while not stop():
        n = poll()
        taken += n
        if not n:
            if once:
                break
            time.sleep(interval)
    return taken


def catch_up(tables: Tables, done: str, key: str, poll: Callable[[float], int], first: int) -> int:
    """Polls until nothing is left; ``poll`` takes all that is left of a share (``todo``).

    A poll looks at all documents and rewrites the buckets it touches, soon all of them. So
    polls of one size cost the square of what is waiting. Here the first is of some
    ``first`` documents and each next one twice as large, so that all together rewrite
    about twice what they leave, and what a failure loses is at most what one poll took.
    No poll sorts, or gathers documents in a task. Gives the number of documents taken."""
    taken, size = 0, first
    while left := todo(tables, done, key, None).count():
        taken += poll(min(1.0, (taken + size) / (taken + left)))
        size *= 2
    return taken
