"""Merging events into keyed tables: latest wins, stubs, quarantine.

A table is a keyed DataFrame; a merge gives its next version. The winner of a key
is a maximum over a struct, which combines on the map side, so a key that was sent
a million times costs a row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

DOCUMENT_FIELDS = ("title", "date", "document_type", "issuer", "url_ar", "url_en", "pdf_url_ar", "pdf_url_en", "ar_source", "en_source", "contentAr", "contentEn", "status")
NODE_PAYLOAD = "struct<id: string, " + ", ".join(f"{f}: string" for f in DOCUMENT_FIELDS) + ">"
EDGE_PAYLOAD = "struct<id: string, source_id: string, target_id: string, relation_type: string>"


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's row of the greatest ``order``, all its columns, nulls included."""
    values = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("_"), *values), order).alias("v"), F.max(order).alias(order))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], order)


def node_event(docs: DataFrame) -> DataFrame:
    """json: the node envelope of each document, with its ``seq`` if it has one."""
    return docs.select(*[c for c in docs.columns if c == "seq"], F.to_json(F.struct(F.lit("node").alias("type"), F.struct("id", *DOCUMENT_FIELDS).alias("payload")), {"ignoreNullFields": "false"}).alias("json"))


def edge_event(relations: DataFrame) -> DataFrame:
    """json: the edge envelope; the page's url isn't sent. ``seq`` as for nodes."""
    return relations.select(*[c for c in relations.columns if c == "seq"], F.to_json(F.struct(F.lit("edge").alias("type"), F.struct("id", "source_id", "target_id", "relation_type").alias("payload"))).alias("json"))


def read_events(raw: DataFrame, json_col: str = "json", order: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node rows, edge rows, quarantine) of envelopes with a sequence number. What
    can't be read, is of another type or has no key is quarantined, not retried."""
    head = raw.withColumn("type", F.get_json_object(json_col, "$.type")).withColumn("body", F.get_json_object(json_col, "$.payload"))
    node = F.from_json("body", NODE_PAYLOAD)
    edge = F.from_json("body", EDGE_PAYLOAD)
    head = head.withColumn("node", F.when(F.col("type") == "node", node)).withColumn("edge", F.when(F.col("type") == "edge", edge))
    good_node, good_edge = F.col("node.id").isNotNull(), F.col("edge.source_id").isNotNull() & F.col("edge.target_id").isNotNull()
    nodes = head.where(good_node).select("node.*", order)
    edges = head.where(good_edge).select(F.col("edge.source_id").alias("src"), F.col("edge.target_id").alias("dst"), F.coalesce("edge.relation_type", F.lit("REFERENCES")).alias("type"), order)
    bad = head.where(~F.coalesce(good_node, F.lit(False)) & ~F.coalesce(good_edge, F.lit(False))).select(json_col, order)
    return nodes, edges, bad


def merge(table: DataFrame | None, events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The table after the events; every property is overwritten, nulls included."""
    return latest_by_key(events if table is None else table.unionByName(events), keys, order)


def stubs(docs: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Endpoints of edges that no document has, as rows of nothing but an id."""
    ends = edges.select(F.col("src").alias(id_col)).union(edges.select("dst")).where(F.col(id_col).isNotNull()).distinct()
    return ends.join(docs.select(id_col), id_col, "left_anti")


def keep_known(new: DataFrame, old: DataFrame, key: str, col: str) -> DataFrame:
    """Upsert by key where ``col`` is only overwritten by a value that isn't null."""
    joined = old.select(key, F.col(col).alias("_old")).join(new.select(key, F.col(col).alias("_new")), key, "full")
    return joined.select(key, F.coalesce("_new", "_old").alias(col))


def link(pairs: DataFrame, docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct (doc_id, topic) pairs whose ends both exist."""
    return pairs.join(docs.select("doc_id"), "doc_id", "left_semi").join(topics.select("topic"), "topic", "left_semi").select("doc_id", "topic").distinct()


def unprocessed(docs: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows that have nothing in ``done`` yet, the first by key."""
    rows = docs.join(done.select(key).distinct(), key, "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def checked(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame, Observation]:
    """(rows to publish, violations, counts) of a batch under a constraint: every key is
    there, and unique.

    Of the rows of one key the last is published. Violations (the keys, reason, rows) say
    which keys had several rows, and how many had no key: a count, not the rows, as one
    key may be most of a batch. The counts (rows, without_key, published, duplicates) are
    those of the action on the published rows.
    """
    seen = Observation()
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    values = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("_"), *values), order).alias("v"), F.max(order).alias(order), F.count(F.lit(1)).alias("rows"))
    best = best.observe(seen, F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("without_key"), F.count_if(~missing).alias("published"), F.count_if(~missing & (F.col("rows") > 1)).alias("duplicates"))
    good = best.where(~missing).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], order)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    bad = counts.where(missing | (F.col("rows") > 1)).select(*keys, F.when(missing, "no key").otherwise("duplicate").alias("reason"), "rows")
    return good, bad, seen


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that break a uniqueness constraint."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
