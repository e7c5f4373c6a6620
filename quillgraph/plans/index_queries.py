"""Registered queries over stored indexes: each writes its index to the shared folder
and searches it there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import providers
from ..functions import text as T
from ..operators import bm25, bm25_blocks, graph, retrieval, vector
from ..operators.state import shared_dir
from ..operators.vector_index import VectorIndex
from ..streaming.merging import Clusters
from . import oracles, queries, worker_queries


def folder(spark, name):
    return f"{shared_dir(spark.range(0))}/{name}-{uuid.uuid4().hex}"


def vector_index(spark, d, metric="cosine"):
    return VectorIndex.build(queries.embeddings(spark, d), folder(spark, "vectors"), metric)


def indexed_topk_cosine(spark, d):
    found = vector_index(spark, d).search(queries.first_vector(spark, d), 50).rows
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def indexed_topk_l2(spark, d):
    found = vector_index(spark, d, "l2sq").search(queries.first_vector(spark, d), 50).rows
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def indexed_topk_batch(spark, d):
    """The mean vector of each label as a query, ten neighbours each."""
    asked = vector.mean_vector(queries.embeddings(spark, d), by=("label",)).withColumnRenamed("label", "query_id")
    found = vector_index(spark, d).search_many(asked, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def grown_index_topk(spark, d):
    """An index of the even labels to which the others are added, one of them twice."""
    rows = queries.embeddings(spark, d)
    index = VectorIndex.build(rows.where("label % 2 = 0"), folder(spark, "vectors"))
    for batch, label in enumerate((1, 3, 5, 7, 9, 9)):
        index.add(rows.where(F.col("label") == label), min(batch, 4) + 1)
    return index.search(queries.first_vector(spark, d), 50).rows.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def indexed_topic_search(spark, d):
    """Topics nearest to the mean vector by the index, and each document's best of them."""
    near = vector_index(spark, d).search(vector.mean_vector(queries.embeddings(spark, d)), 50).rows.withColumnRenamed("id", "topic")
    return retrieval.topic_scores(near, queries.has_topic(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


def block_index_search(spark, d):
    """``stored_index_search`` over blocks with bounds."""
    docs = queries.documents(spark, d)
    found = []
    for name, rows, tokens, words in (
        ("en", docs.where("lang = 'en'"), T.tokens(F.col("text")), providers.translate(" ".join(queries.QUERY_TERMS))["en"].split()),
        ("ar", docs.select("doc_id", worker_queries.arabic_text().alias("text")), T.arabic_tokens(F.col("text")), providers.translate(f"{worker_queries.ARABIC[0]} {worker_queries.ARABIC[8]}")["ar"].split()),
    ):
        path = folder(spark, f"blocks-{name}")
        bm25_blocks.BlockIndex.save(bm25.build(rows, tokens), path)
        found.append((bm25_blocks.BlockIndex.load(spark, path), queries.terms(spark, words)))
    return bm25_blocks.search(found, 50).select("doc_id", F.round("score", 6).alias("score"))


def grown_clusters(spark, d):
    """Topics in four batches, of which the last brings some of the others again."""
    found = Clusters(spark, folder(spark, "clusters"), queries.SIMILAR)
    rows = queries.embeddings(spark, d)
    for number, part in enumerate(("vec_id % 2 = 0", "vec_id % 4 = 1", "vec_id % 8 = 3", "vec_id % 8 > 4")):
        found.add(rows.where(part), number)
    return found


def grown_components(spark, d):
    return grown_clusters(spark, d).roots().select(F.col("node").alias("topic"), "root")


def grown_contract(spark, d):
    """Edges after topics that came in batches were merged."""
    topics, edges = queries.embeddings(spark, d).select(F.col("vec_id").alias("topic")), queries.has_topic(spark, d)
    return graph.contract(edges, grown_clusters(spark, d).chosen(graph.degree(topics, edges, "topic", "topic")))


QUERIES = {f.__name__: f for f in (indexed_topk_cosine, indexed_topk_l2, indexed_topk_batch, grown_index_topk, indexed_topic_search, block_index_search, grown_components, grown_contract)}

ORACLES = {
    "indexed_topk_cosine": oracles.ORACLES["dense_topk_cosine"],
    "indexed_topk_l2": oracles.ORACLES["dense_topk_l2"],
    "indexed_topk_batch": oracles.ORACLES["dense_topk_batch"],
    "grown_index_topk": oracles.ORACLES["dense_topk_cosine"],
    "indexed_topic_search": oracles.ORACLES["topic_search_docs"],
    "block_index_search": worker_queries.ORACLES["stored_index_search"],
    "grown_components": oracles.ORACLES["topic_components"],
    "grown_contract": oracles.ORACLES["topic_contract"],
}
