"""Stored postings in blocks with bounds, of which a search skips most.

Ding and Suel, "Faster top-k document retrieval using block-max indexes" (2011), with
blocks aligned to windows of documents: a window is some ``window_docs`` documents of
about one length, and a block is one term's postings in one window, with the greatest
part of a score that one of them can have. The sum of a query's bounds over a window is
then an upper bound of all its documents, without looking at any.

A search adds up the bounds (of the headers alone: the postings are columns of their
own, and aren't read), scores the most promising windows, and then only those whose
bound reaches the k-th score so far. Results are those of the whole index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25
from .bm25 import B, EPSILON, K1
from .state import written

CLASSES = 64  # of lengths
SLACK = 1e-9
MOST_LISTED = 1000  # windows that a scan is told one by one


def part(tf: Column, length: Column, avg_len: Column | float) -> Column:
    """A posting's part of a score, before its term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def windows(docs: DataFrame, window_docs: int) -> DataFrame:
    """doc_id, len, win. Classes of lengths are between quantiles, and a class of many
    documents, of one length even, is dealt by hash."""
    at = docs.agg(F.percentile_approx("len", [i / CLASSES for i in range(1, CLASSES)], 100 * CLASSES).alias("q")).head().q or []  # CLASSES numbers
    at = sorted(set(at))
    classed = docs.withColumn("class", F.size(F.filter(F.lit(at).cast("array<long>"), lambda x: x < F.col("len"))) if at else F.lit(0))
    n = {r["class"]: r.n for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # CLASSES rows at most
    if not n:
        return docs.withColumn("win", F.lit(0).cast("long"))
    parts = F.element_at(F.map_from_arrays(F.lit(list(n)), F.lit([-(-x // window_docs) for x in n.values()])), F.col("class"))
    return classed.select("doc_id", "len", (F.col("class").cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), parts)).alias("win"))


@dataclass(frozen=True)
class Found:
    rows: DataFrame  # doc_id, score: the best k
    windows: int  # that have a term of the query
    read: int  # whose postings were read


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame  # term, win, bound, n, docs, tfs, lens
    index: bm25.Index  # terms and totals

    @staticmethod
    def save(index: bm25.Index, path: str, window_docs: int = 1024, files: int | None = None) -> None:
        """Writes the blocks of an index, by term. A block has a window's documents at most."""
        spark, index = index.terms.sparkSession, index.counted()
        totals = index.totals.select("n_docs", "avg_len").head()  # one row
        placed = written(windows(index.docs, window_docs))
        rows = index.postings.join(placed, "doc_id")
        one = F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))
        each = rows.groupBy("term", "win").agg(F.max(part(F.col("tf"), F.col("len"), F.lit(totals.avg_len if totals else 1.0))).alias("bound"), F.array_sort(F.collect_list(one)).alias("p"))
        blocks = each.select("term", "win", "bound", F.size("p").alias("n"), F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))
        files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks.repartitionByRange(files, "term", "win").sortWithinPartitions("term", "win").write.mode("overwrite").parquet(f"{path}/blocks")
        index.terms.select("term", "df").write.mode("overwrite").parquet(f"{path}/terms")
        index.totals.select("n_docs", "avg_len").write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BlockIndex:
        blocks, terms, totals = (spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "totals"))
        return BlockIndex(blocks, bm25.Index(terms, totals))

    def search(self, query_terms: DataFrame, k: int, probe: int = 8, epsilon: float = EPSILON) -> Found:
        """The k best documents, ties to the smaller id. ``query_terms`` has a row for
        each occurrence of a term (a query's terms are few: they are put into the plan).
        ``probe`` windows, those of the greatest bounds, are scored first, then eight times
        as many of those that still can, and so on; beyond a thousand, all at once."""
        times = {r["term"]: r["times"] for r in query_terms.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("times")).collect()}
        known = bm25.idf(self.index, epsilon).where(F.col("term").isin(*times)).collect() if times else []
        if not known or k < 1:
            return Found(self.blocks.select(F.get("docs", F.lit(0)).alias("doc_id"), F.lit(0.0).alias("score")).where("false"), 0, 0)
        avg_len = known[0].avg_len
        weights = F.create_map(*[F.lit(x) for r in known for x in (r.term, float(times[r.term] * r.idf))])
        own = self.blocks.where(F.col("term").isin(*[r.term for r in known])).withColumn("w", F.element_at(weights, F.col("term")))
        # a term of negative weight can be absent from a document, and then takes nothing off
        upper = written(own.groupBy("win").agg(F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("bound")).alias("upper")))
        def scored(blocks: DataFrame) -> DataFrame:
            each = blocks.select("w", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
            score = F.sum(F.col("w") * part(F.col("p.tfs"), F.col("p.lens"), F.lit(avg_len)))
            return each.groupBy(F.col("p.docs").alias("doc_id")).agg(score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)

        total, read, step, rest, best = upper.count(), 0, probe, upper, None
        while True:
            some = rest.orderBy(F.desc("upper"), "win").limit(step).collect() if step <= MOST_LISTED else None
            own_blocks = own.join(rest.select("win"), "win", "left_semi") if some is None else own.where(F.col("win").isin([r.win for r in some]))
            found = scored(own_blocks)
            best = written(found if best is None else best.unionByName(found).orderBy(F.desc("score"), "doc_id").limit(k))
            read += rest.count() if some is None else len(some)
            reached = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).head()
            if some is None or not some:
                return Found(best, total, read)
            rest = rest.where((F.col("upper") < some[-1].upper) | ((F.col("upper") == some[-1].upper) & (F.col("win") > some[-1].win)))
            if reached.n == k:
                rest = rest.where(F.col("upper") >= reached.least - SLACK * max(1.0, abs(reached.least)))
            if rest.isEmpty():
                return Found(best, total, read)
            step *= 8


def search(indexes: list[tuple[BlockIndex, DataFrame]], k: int) -> DataFrame:
    """The k best documents over several languages' (index, query terms), as ``bm25.search``."""
    best = [bm25.normalised(index.search(words, k).rows) for index, words in indexes]
    return bm25.best_of(*best).orderBy(F.desc("score"), "doc_id").limit(k)
