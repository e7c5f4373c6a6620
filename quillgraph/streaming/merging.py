"""Clusters of similar topics that grow with the topics.

A batch of topics meets the stored vectors of the batches before by their cells, and
itself; what is linked unites the clusters that were there. So old vectors never meet
each other again, and clusters are those that a run over all topics would find.

    vectors/          an index by cells (``vector_index``), one vector of each set of
                      equal ones of a batch
    known/batch=n     ids that the batch brought
    roots             a keyed table (``workers.Tables``): the smallest id of the cluster
                      of each topic that has one; a version a batch

A topic that is known keeps the vector that it has, as do topics in ``upsert``. Rows
without an id, or with a vector that isn't usable (null, empty, not finite, of no length),
take no part, and don't count as known. Of several rows of one id in a batch the
smallest vector counts. A batch that is run again under its number gives the same, as
long as none came after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, vector
from ..operators.state import written
from ..operators.vector_index import VectorIndex, usable
from . import workers

KNOWN = "id long, batch long"


class Clusters:
    def __init__(self, spark: SparkSession, root: str, threshold: float, buckets: int = 16):
        self.spark, self.root, self.threshold = spark, root, threshold
        self.tables = workers.Tables(spark, root, buckets)

    def known(self, before: int) -> DataFrame:
        """id: of the batches below ``before``."""
        path = f"{self.root}/known"
        if not self.tables.fs.exists(self.tables.path_of(path)):
            return self.spark.createDataFrame([], "id long")
        return self.spark.read.schema(KNOWN).parquet(path).where(F.col("batch") < before).select("id")

    def roots(self, before: int | None = None) -> DataFrame:
        """node, root: of every topic that has a similar one."""
        held = self.tables.read("roots", before)
        return self.spark.createDataFrame([], "node long, root long") if held is None else held.select("node", "root")

    def add(self, topics: DataFrame, number: int, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Adds a batch; ``number`` grows from batch to batch."""
        rows = topics.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), "cosine"))
        known = self.known(number)
        rows = written(rows.join(known, "id", "left_anti").groupBy("id").agg(F.min("v").alias("v")))
        rows.select("id").write.mode("overwrite").parquet(f"{self.root}/known/batch={number}")
        if rows.isEmpty():
            return
        firsts = written(rows.groupBy("v").agg(F.min("id").alias("id")))  # equal vectors meet the others once
        copies = rows.join(firsts.withColumnRenamed("id", "first"), "v").where("id <> first").select(F.col("id").alias("x"), F.col("first").alias("y"))
        links = copies.union(vector.similar_pairs(firsts, self.threshold, "id", "v").select("a", "b"))
        old = self.roots(number)
        if not known.isEmpty():
            index = VectorIndex(self.spark, f"{self.root}/vectors")
            names = old.select(F.col("node").alias("id"), F.col("root").alias("name"))
            links = links.union(index.within(firsts.select(F.col("id").alias("query_id"), F.col("v").alias("query_vec")), self.threshold, names, number))
            index.add(firsts, number, "id", "v")
        else:
            VectorIndex.build(firsts, f"{self.root}/vectors", id_col="id", batch=number, vec_col="v")
        self.unite(written(links), old, number)

    def unite(self, links: DataFrame, old: DataFrame, number: int) -> None:
        """Links are of new topics, with each other and with old clusters or topics that
        had none. Writes the roots of those and of clusters that go into another one."""
        found = written(graph.components(links))  # a cluster's root is its smallest id, so the smallest root is the united one's
        moved = found.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("to"))
        members = old.join(moved, "root").select("node", F.col("to").alias("root"))
        changes = found.union(members).distinct().join(old, ["node", "root"], "left_anti")
        self.tables.write("roots", number, changes.withColumn("seq", F.lit(number).cast("long")), ["node"], workers.latest(["node"]))

    def chosen(self, degrees: DataFrame) -> DataFrame:
        """topic, root, canonical: as ``graph.merge_clusters`` of all pairs."""
        return graph.chosen(self.roots(), degrees)


def follow_topics(rows: DataFrame, clusters: Clusters, once: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> StreamingQuery:
    """Adds a stream of topics, a batch at a time; ``once`` stops when what is there is done."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: clusters.add(batch, number, id_col, vec_col)).option("checkpointLocation", f"{clusters.root}/_stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
