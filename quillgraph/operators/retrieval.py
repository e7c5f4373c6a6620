"""Staged retrieval: fuse sparse, dense and topic scores, expand, rerank, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .bm25 import normalised

WEIGHTS = {"bm25": 0.2, "chunk": 0.6, "topic": 0.2}


def topic_scores(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, score: a document's best topic; topics (topic, score), edges (doc_id, topic)."""
    return edges.join(topics, "topic").groupBy("doc_id").agg(F.max("score").alias("score"))


def fuse(dense: DataFrame, bm25: DataFrame, topics: DataFrame, k: int, weights: dict[str, float] = WEIGHTS, mode: str = "reweight") -> DataFrame:
    """The k best of ``dense`` (id, doc_id, score, ...) after weighting; dense scores
    are normalised by their maximum, the others count 0 where missing. ``mode``
    "union" also admits documents that only the other two found."""
    rows = normalised(dense).withColumnRenamed("score", "chunk_score")
    if mode == "union":
        others = bm25.select("doc_id").union(topics.select("doc_id")).distinct().join(dense.select("doc_id"), "doc_id", "left_anti")
        rows = rows.unionByName(others.withColumn("chunk_score", F.lit(0.0)), allowMissingColumns=True)
    rows = rows.join(bm25.select("doc_id", F.col("score").alias("bm25_score")), "doc_id", "left").join(topics.select("doc_id", F.col("score").alias("topic_score")), "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("bm25_score", "topic_score")})
    final = weights["bm25"] * F.col("bm25_score") + weights["chunk"] * F.col("chunk_score") + weights["topic"] * F.col("topic_score")
    return rows.withColumn("score", final).orderBy(F.desc("score"), "id").limit(k)


def expand(candidates: DataFrame, docs: DataFrame, edges: DataFrame, topics_by: str = "topic") -> DataFrame:
    """Candidates with ``context``: their document's header, then their text. Topics
    are gathered for the candidates' documents only, in order."""
    wanted = candidates.select("doc_id").distinct()
    names = edges.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(topics_by)).alias("topics"))
    meta = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "title", "issuer", "date", "document_type")
    rows = candidates.join(meta, "doc_id", "left").join(names, "doc_id", "left")
    head = T.context_header(F.col("title"), F.col("issuer"), F.col("date"), F.col("document_type"), F.col("topics"))
    return rows.withColumn("context", F.concat(head, F.col("text"))).drop("title", "issuer", "date", "document_type", "topics")


def expand_simple(chunks: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``expand``, but a chunk whose document is missing keeps its bare text."""
    rows = expand(chunks, docs, edges).join(docs.select("doc_id", F.lit(True).alias("known")).distinct(), "doc_id", "left")
    return rows.withColumn("context", F.when(F.col("known"), F.col("context")).otherwise(F.col("text"))).drop("known")


def rerank(expanded: DataFrame, scored, n: int) -> DataFrame:
    """The n best by ``scored`` (a column over the expanded rows), ties to the smaller id."""
    return expanded.withColumn("rerank_score", scored).orderBy(F.desc("rerank_score"), "id").limit(n)


def ranked(rows: DataFrame, by: str = "score", key: str = "id") -> DataFrame:
    """``rank`` from 1. For result lists, which are short by then."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))


def metrics(rows: DataFrame, n: int, score: str = "rerank_score", threshold: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """mrr, precision, recall, candidates, relevant over ranked rows (rank, score):
    relevant is a score above the threshold; zero where nothing can be divided."""
    good = F.col(score) > threshold
    hits = F.count_if(good & (F.col("rank") <= n))
    return rows.groupBy(*(by or [])).agg(
        F.coalesce(1.0 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(hits.cast("double"), F.lit(float(n))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hits.cast("double"), F.count_if(good).cast("double")), F.lit(0.0)).alias("recall"),
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(good).alias("relevant"),
    )


def metrics_of(rows: DataFrame, n: int, by: str, order, key: str, score: str = "rerank_score", threshold: float = 0.0) -> DataFrame:
    """``metrics`` of unranked rows, ranked by ``order`` (greatest first, then the least
    ``key``) in each list ``by``. No list is sorted: only its first n rows are looked
    for, its first relevant row, and the number of rows ahead of that one."""
    place = F.struct((-order).alias("o"), F.col(key).alias("k"))
    good = F.col(score) > threshold
    rows = rows.select(by, place.alias("place"), good.alias("good"))
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("good").alias("relevant"), F.min(F.when(F.col("good"), F.col("place"))).alias("best"))
    ahead = rows.join(sums.select(by, "best"), by).groupBy(by).agg(F.count_if(F.col("place") <= F.col("best")).alias("rank"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("place"))).where(F.col("r") <= n).groupBy(by).agg(F.count_if("good").alias("hits"))
    found = sums.join(ahead, by).join(top, by)
    share = lambda of: F.coalesce(F.try_divide(F.col("hits").cast("double"), of), F.lit(0.0))
    return found.select(by, F.coalesce(F.try_divide(F.lit(1.0), F.col("rank")), F.lit(0.0)).alias("mrr"), share(F.lit(float(n))).alias("precision"), share(F.col("relevant").cast("double")).alias("recall"), "candidates", "relevant")


def context_block(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """context: numbered excerpts (rank, context) of one result list, in order."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda s: F.concat(F.lit("Excerpt "), s["rank"].cast("string"), F.lit(":\n"), s["context"]))
    return rows.groupBy(*(by or [])).agg(F.array_join(each, "\n\n---\n\n").alias("context"))


def display(rows: DataFrame, length: int = 150, digits: int = 4) -> DataFrame:
    """What a result table shows: rank, rounded scores, the start of the text."""
    return ranked(rows).select("rank", F.round("score", digits).alias("score"), "doc_id", T.preview(F.col("text"), length).alias("excerpt"))


def community_prompt(groups: DataFrame, topics: int = 20, titles: int = 10) -> DataFrame:
    """community, prompt: the first topics in a line, the first titles as bullets,
    empty ones dropped after the cut; a dash where there are none."""
    dash = lambda c: F.when(c == "", F.lit("—")).otherwise(c)
    names = F.array_join(F.slice("topics", 1, topics), ", ")
    lines = F.transform(F.filter(F.slice("titles", 1, titles), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit("- "), x))
    return groups.select("community", F.concat(F.lit("Topics: "), dash(names), F.lit("\n\nDocument titles:\n"), dash(F.array_join(lines, "\n"))).alias("prompt"))
