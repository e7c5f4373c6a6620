"""Commands over a folder of keyed tables: ``python -m quillgraph <command> --root <folder>``."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .functions import text as T
from .operators import bm25, crawl, graph, retrieval, upsert, vector
from .sources import inputs, sinks
from .streaming import workers

STATES = "url string, category string, seq long, state string, at string"
KEYS = {"documents": ["id"], "relations": ["src", "dst"], "chunks": ["id"], "topics": ["name"], "has_topic": ["doc_id", "name"], "communities": ["community"]}


class Store:
    """The tables of a root, empty ones where nothing was written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tables = spark, root, workers.Tables(spark, root)

    def read(self, name: str, schema: str) -> DataFrame:
        found = self.tables.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those of their keys."""
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0).cast("long"))
        self.tables.write(name, self.tables.next(name), rows, keys, lambda old, new: new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new))

    def queue(self) -> str:
        return f"{self.root}/_queue"


def now():
    return F.lit(datetime.now(UTC).isoformat())


def crawler(store: Store, a: argparse.Namespace) -> DataFrame:
    """Discovers urls in listing pages (JSON: category, page, html), extracts fetched
    pages (JSON: url, html), sends records to the queue and moves their states."""
    states = store.read("crawl", STATES)
    if a.reset:
        store.put("crawl", states.withColumn("state", F.lit("GONE")), ["url"])
    if a.retry_failed:
        store.put("crawl", crawl.requeue(states, now()).where("state = 'PENDING'"), ["url"])
    if a.listings:
        states = store.read("crawl", STATES).where("state <> 'GONE'")
        pages = store.spark.read.schema("category string, page long, html string").json(a.listings)
        pages = pages.where(F.col("category") == a.category) if a.category else pages
        pages = pages.where(F.col("page") <= a.max_pages) if a.max_pages else pages
        found = pages.select("category", "page").distinct().join(inputs.listing(pages).select("category", "page", "url"), ["category", "page"], "left")
        start = store.read("progress", "category string, page long, state string, seq long").select("category", "page")
        new, progress = crawl.discover(found, start, states)
        store.put("crawl", new.select("url", "category", "seq", F.lit("PENDING").alias("state"), F.lit(None).cast("string").alias("at")), ["url"])
        store.put("progress", progress, ["category"])
    if a.pages:
        states = store.read("crawl", STATES)
        todo = crawl.queue_range(states.where("state = 'PENDING'"), most=a.max_urls)
        pages = store.spark.read.schema("url string, html string").json(a.pages).join(todo.select("url", "category"), "url")
        docs, edges = inputs.records(pages)
        seq = F.unix_micros(F.current_timestamp()).alias("seq")
        sinks.push_events(upsert.node_event(docs.select("id", *upsert.DOCUMENT_FIELDS, seq)), store.queue())
        sinks.push_events(upsert.edge_event(edges.select("id", "source_id", "target_id", "relation_type", seq)), store.queue())
        sinks.write_documents(docs, f"{store.root}/_json")
        done = docs.select("id").union(edges.select("id")).withColumn("ok", F.lit(True))
        results = pages.select("url", T.last_segment(F.col("url")).alias("id")).join(done, "id", "left").select("url", F.coalesce("ok", F.lit(False)).alias("ok"))
        store.put("crawl", crawl.move(states, results, now()), ["url"])
    return store.read("crawl", STATES).where("state <> 'GONE'").groupBy("state").count()


def ingestor(store: Store, a: argparse.Namespace) -> DataFrame:
    workers.ingest(store.spark, store.queue(), store.root, a.once).awaitTermination()
    return store.tables.read("documents").groupBy("status").count()


def schema(store: Store, a: argparse.Namespace) -> DataFrame:
    """Keys that more than one row of a table has."""
    found = [upsert.duplicate_keys(t, *keys).select(F.lit(name).alias("table"), F.concat_ws(" ", *keys).alias("key"), "n") for name, keys in KEYS.items() if (t := store.tables.read(name)) is not None]
    return graph_union(found, store, "table string, key string, n long")


def graph_union(rows: list[DataFrame], store: Store, schema_: str) -> DataFrame:
    out = store.spark.createDataFrame([], schema_)
    for r in rows:
        out = out.unionByName(r)
    return out


def embed(c):
    return providers.embedding(c, providers.HashEmbedder())


def chunker(store: Store, a: argparse.Namespace) -> DataFrame:
    workers.follow(lambda: workers.chunk_poll(store.tables, a.batch_size, embed=embed), a.interval, a.once)
    return store.tables.read("chunks").groupBy("language").count()


def topics(store: Store, a: argparse.Namespace) -> DataFrame:
    workers.follow(lambda: workers.topic_poll(store.tables, providers.offline_topics, embed, a.batch_size), a.interval, a.once)
    return store.tables.read("has_topic").groupBy("name").count().orderBy(F.desc("count"), "name").limit(10)


def merge(store: Store, a: argparse.Namespace) -> DataFrame:
    """Merges topics whose vectors are similar; with --dry-run only shows how."""
    rows, edges = store.tables.read("topics"), store.tables.read("has_topic")
    numbered = rows.where("embedding is not null").select("name", "embedding", F.xxhash64("name").alias("vec_id"))
    pairs = vector.similar_pairs(numbered, a.threshold)
    name = lambda side: numbered.select(F.col("vec_id").alias(side), F.col("name").alias(f"name_{side}"))
    named = pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    found = graph.merge_clusters(named, graph.degree(rows.select(F.col("name").alias("topic")), edges, "topic", "name"))
    if not a.dry_run:
        moved = graph.contract(edges.select("doc_id", F.col("name").alias("topic")), found).select("doc_id", F.col("topic").alias("name"), F.lit(0).cast("long").alias("seq"))
        left = graph.without_merged(rows.withColumnRenamed("name", "topic"), found).withColumnRenamed("topic", "name")
        for table, new in (("has_topic", moved), ("topics", left)):
            keys, version = KEYS[table], store.tables.next(table)
            gone = store.tables.read(table).join(new.select(*keys), keys, "left_anti").select(*keys, F.lit(True).alias("gone"))
            changes = new.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
            store.tables.write(table, version, changes, keys, lambda old, c: c.where("not gone").drop("gone"))
    return found.where("topic <> canonical")


def communities(store: Store, a: argparse.Namespace) -> DataFrame:
    edges = store.tables.read("has_topic")
    placed = graph.louvain(edges.select(F.xxhash64(F.lit("d"), "doc_id").alias("x"), F.xxhash64(F.lit("t"), "name").alias("y"), F.lit(1.0).alias("w")))
    topic = edges.select("name", F.xxhash64(F.lit("t"), "name").alias("node")).distinct().join(placed, "node").select(F.col("name").alias("topic"), "community")
    docs = store.tables.read("documents").select("id", "title", F.xxhash64(F.lit("d"), "id").alias("node")).join(placed, "node")
    groups = topic.select("community").distinct()
    sinks.persist_communities(groups, graph.belongs_to(docs.withColumnRenamed("id", "doc_id"), topic, groups), providers.community_label, f"{store.root}/communities")
    return retrieval.community_prompt(graph.community_members(docs.select("community", "title"), topic))


def index(store: Store, a: argparse.Namespace) -> DataFrame:
    docs = store.tables.read("documents")
    for lang, col, tokens in (("en", "contentEn", T.tokens), ("ar", "contentAr", T.arabic_tokens)):
        bm25.build(docs.where(T.has_text(F.col(col))), tokens(F.col(col)), "id").save(f"{store.root}/index/{lang}")
    return docs.agg(F.count_if(T.has_text(F.col("contentEn"))).alias("en"), F.count_if(T.has_text(F.col("contentAr"))).alias("ar"))


def query_vector(store: Store, query: str) -> DataFrame:
    """The mean of the query's vectors in both languages."""
    both = store.spark.createDataFrame([(t,) for t in providers.translate(query).values()], "text string").select(embed(F.col("text")).alias("embedding"))
    return vector.mean_vector(both)


def edges_of(store: Store) -> DataFrame:
    return store.read("has_topic", "doc_id string, name string, seq long").select("doc_id", F.col("name").alias("topic"))


def search(store: Store, a: argparse.Namespace) -> DataFrame:
    near = vector.nearest(store.tables.read("chunks").where("embedding is not null"), query_vector(store, a.query), a.top_k, id_col="id")
    rows = near.join(store.tables.read("chunks").select("id", "doc_id", "text"), "id")
    docs = store.tables.read("documents").withColumnRenamed("id", "doc_id")
    found = retrieval.expand_simple(rows, docs, edges_of(store))
    return retrieval.display(found.withColumn("text", F.col("context")), 200, 3)


def hybrid(store: Store, a: argparse.Namespace) -> DataFrame:
    asked = providers.translate(a.query)
    near = vector.nearest(store.tables.read("chunks").where("embedding is not null"), query_vector(store, a.query), a.top_k, id_col="id")
    dense = near.join(store.tables.read("chunks").select("id", "doc_id", "text"), "id")
    terms = lambda lang: store.spark.createDataFrame([(asked[lang],)], "text string").select(F.explode((T.tokens if lang == "en" else T.arabic_tokens)(F.col("text"))).alias("term"))
    sparse = bm25.search([(bm25.Index.load(store.spark, f"{store.root}/index/{lang}"), terms(lang)) for lang in ("en", "ar")], a.top_k)
    known = store.read("topics", "name string, embedding array<float>, seq long").select(F.col("name").alias("topic"), "embedding").where("embedding is not null")
    names = store.spark.createDataFrame([(n,) for n in providers.query_topics(a.query)] or [(" ",)], "text string").select(embed(F.col("text")).alias("embedding"))
    by_topic = retrieval.topic_scores(vector.nearest(known, vector.mean_vector(names), a.top_k, id_col="topic"), edges_of(store))
    rows = retrieval.fuse(dense, sparse, bm25.normalised(by_topic), a.top_k)
    docs = store.tables.read("documents").withColumnRenamed("id", "doc_id")
    expanded = retrieval.expand(rows, docs, edges_of(store))
    best = retrieval.rerank(expanded, providers.rerank_score(a.query, F.col("context"), providers.OverlapReranker()), a.final_n)
    return retrieval.display(best.withColumn("text", F.col("context")))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, *options):
        p = commands.add_parser(run.__name__, description=run.__doc__)
        p.add_argument("--root", required=True)
        for name, more in options:
            p.add_argument(name, **more)
        p.set_defaults(run=run)

    flag, number = {"action": "store_true"}, lambda default=None: {"type": int, "default": default}
    command(crawler, ("--listings", {}), ("--pages", {}), ("--max-urls", number()), ("--max-pages", number()), ("--category", {}), ("--status", flag), ("--reset", flag), ("--retry-failed", flag))
    command(ingestor, ("--once", flag))
    command(schema)
    command(chunker, ("--interval", {"type": float, "default": 60.0}), ("--batch-size", number(100)), ("--once", flag))
    command(topics, ("--interval", {"type": float, "default": 20.0}), ("--batch-size", number(1)), ("--once", flag))
    command(merge, ("--threshold", {"type": float, "default": 0.88}), ("--dry-run", flag))
    command(communities)
    command(index)
    command(search, ("--query", {"required": True}), ("--top-k", number(5)))
    command(hybrid, ("--query", {"required": True}), ("--top-k", number(50)), ("--final-n", number(5)))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list:
    """Runs a command, prints its result and gives it as rows."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    rows = a.run(Store(spark, a.root), a).limit(1000).collect()  # what a console shows
    for row in rows:
        print(*row, sep="\t")
    return rows
