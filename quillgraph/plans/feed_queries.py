"""Registered queries of feeds, stateful discovery, constraints, and of documents with
several topics each."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from .. import providers
from ..operators import retrieval, vector
from ..sources import inputs, sinks
from ..streaming import discovery, feeds, workers
from . import oracles, queries, worker_queries
from .worker_queries import as_nodes, folder


def chunk_feed(spark, d):
    """``chunk_worker`` by the feed: turns come through the ingestor in two parts, those
    of the second with some of the first again, and a follower chunks what is new."""
    root, queue = folder(spark, "graph"), folder(spark, "queue")
    rows = inputs.table(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("id"), F.when(F.col("role") == "user", "مرسوم").alias("contentAr"), F.col("text").alias("contentEn"), F.pmod("conv_id", F.lit(4)).cast("long").alias("seq"))
    embed = lambda c: providers.embedding(c, providers.HashEmbedder(16))
    for part in ("seq < 2", "seq > 0"):
        sinks.push_events(workers.upsert.node_event(as_nodes(rows.where(part))), queue)
        workers.ingest(spark, queue, root).awaitTermination()
        feeds.chunk_stream(spark, root, embed=embed).awaitTermination()
    found = feeds.held(spark, root, "chunks", f"{feeds.CHUNKS}, embedding array<float>", ["id"])
    return found.select("id", "doc_id", "language", F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dims"))


@contextlib.contextmanager
def settings(spark, values):
    """Session settings that are put back."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discovery_stream(spark, d):
    """Listing pages that arrive in two parts, the later ones first, read by category up
    to the first empty page."""
    pages, out, mark = (folder(spark, name) for name in ("listing", "found", "mark"))
    rows = worker_queries.listings(spark, d).groupBy("category", "page").agg(F.sort_array(F.collect_list("url")).alias("urls"))  # ten urls a page
    with settings(spark, discovery.SETTINGS):
        for part in ("page % 2 = 0", "page % 2 = 1"):
            rows.where(part).write.mode("append").json(pages)
            stream = spark.readStream.schema(discovery.LISTING).json(pages)
            discovery.discovered(stream).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(discovery.FOUND).parquet(out)


def published_turns(spark, d):
    """Conversations published by id, which many turns share: the last turn of each, and
    how many rows broke the constraint."""
    tables = workers.Tables(spark, folder(spark, "graph"), 8)
    rows = inputs.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), "role")
    tables.publish("conversations", 0, rows, ["conv_id"])
    bad = tables.read("conversations_violations").select(F.get_json_object("key", "$.conv_id").cast("long").alias("conv_id"), "reason", "rows")
    return tables.read("conversations").select("conv_id", F.col("seq").alias("turn"), "role").join(bad, "conv_id", "left")


def has_topics(spark, d):
    """Each document is linked to up to three topics, by number."""
    n = F.broadcast(queries.embeddings(spark, d).agg(F.count(F.lit(1)).alias("n")))  # one row
    rows = queries.documents(spark, d).crossJoin(n)
    return rows.select("doc_id", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("doc_id") * a + b, "n") for a, b in ((1, 0), (7, 3), (13, 5))]))).alias("topic"))


def topics_best(spark, d):
    """Of each document's topics near the mean vector the best score, and how many there were."""
    near = vector.nearest(queries.embeddings(spark, d), vector.mean_vector(queries.embeddings(spark, d)), 200).withColumnRenamed("vec_id", "topic")
    edges = has_topics(spark, d)
    n = edges.join(near, "topic").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return retrieval.topic_scores(near, edges).join(n, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "n")


def topics_context(spark, d):
    """Contexts of all documents with their topics, gathered once each, in order."""
    edges = has_topics(spark, d)
    rows = queries.documents(spark, d).select(F.col("doc_id").alias("id"), "doc_id", "text")
    found = retrieval.expand(rows, queries.as_records(spark, d), edges.union(edges).withColumn("topic", F.col("topic").cast("string")))
    return found.select("doc_id", F.md5(F.col("context")).alias("context_md5"), F.length("context").cast("long").alias("context_length"))


QUERIES = {f.__name__: f for f in (chunk_feed, discovery_stream, published_turns, topics_best, topics_context)}

_EDGES = "edges AS (SELECT DISTINCT doc_id, unnest([doc_id % n, (doc_id * 7 + 3) % n, (doc_id * 13 + 5) % n]) AS topic FROM documents, (SELECT count(*) AS n FROM embeddings))"

ORACLES = {
    "chunk_feed": worker_queries.ORACLES["chunk_worker"],
    "discovery_stream": """
WITH l AS (SELECT (page_id % 3)::VARCHAR AS category, page_id // 30 + 1 AS page, url FROM pages),
ends AS (SELECT category, min(page) FILTER (page % 9 = 0) AS last FROM l GROUP BY category)
SELECT category, page, url, 'DISCOVERING' AS state FROM l JOIN ends USING (category) WHERE last IS NULL OR page < last
UNION ALL SELECT category, last, NULL, 'DISCOVERY_DONE' FROM ends WHERE last IS NOT NULL""",
    "published_turns": """
SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, CASE WHEN count(*) > 1 THEN 'duplicate' END AS reason, CASE WHEN count(*) > 1 THEN count(*) END AS rows
FROM conversations GROUP BY conv_id""",
    "topics_best": f"""
WITH {oracles.VEC}, {oracles.MEAN}, {_EDGES},
near AS (SELECT vec_id AS topic, list_cosine_similarity(e, q) AS score FROM v, m ORDER BY score DESC, topic LIMIT 200)
SELECT doc_id, round(max(score), 6) AS score, count(*) AS n FROM edges JOIN near USING (topic) GROUP BY doc_id""",
    "topics_context": f"""
WITH {_EDGES}, t AS (SELECT doc_id, array_to_string(list(topic::VARCHAR ORDER BY topic::VARCHAR), ', ') AS topics FROM edges GROUP BY doc_id),
c AS (SELECT doc_id, '[Document: ' || 'Document ' || doc_id || ' | Issuer: ' || source || ' | ? | ' || lang || ']' || chr(10) || '[Topics: ' || topics || ']' || chr(10) || chr(10) || text AS context FROM documents JOIN t USING (doc_id))
SELECT doc_id, md5(context) AS context_md5, length(context) AS context_length FROM c""",
}
