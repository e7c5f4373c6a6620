"""Crawl state as keyed tables: what is pending, visited, done, failed.

States: visited(url), pending(seq, url), url_category(url, category), done(id),
failed(id), progress(category_url, page). An operation gives the next version of
the tables that it changes. ``move`` and ``requeue`` keep what a url goes through in
one table (url, category, seq, state, at), so that a move is a single write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def enqueue(found: DataFrame, visited: DataFrame, pending: DataFrame) -> DataFrame:
    """url, category, seq: found urls (url, category, seq) that are neither visited
    nor pending, each once, with its first category."""
    new = found.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by("category", "seq").alias("category"), F.min("seq").alias("seq"))
    return new.join(visited.select("url"), "url", "left_anti").join(pending.select("url"), "url", "left_anti")


def queue_range(pending: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """The queue in order, from a place on."""
    rows = pending.orderBy("seq", "url")
    rows = rows.offset(start) if start else rows
    return rows.limit(most) if most is not None else rows


def move(states: DataFrame, results: DataFrame, at) -> DataFrame:
    """The states after results (url, ok): a pending url becomes DONE or FAILED at the
    time ``at``. Of several results of a url one success is enough; results of urls
    that aren't pending change nothing."""
    each = results.groupBy("url").agg(F.bool_or("ok").alias("ok"))
    rows = states.join(each, "url", "left").withColumn("moved", (F.col("state") == "PENDING") & F.col("ok").isNotNull())
    state = F.when(F.col("moved"), F.when(F.col("ok"), "DONE").otherwise("FAILED")).otherwise(F.col("state"))
    return rows.select("url", "category", "seq", state.alias("state"), F.when(F.col("moved"), at).otherwise(F.col("at")).alias("at"))


def requeue(states: DataFrame, at) -> DataFrame:
    """The states with every failed url pending again."""
    failed = F.col("state") == "FAILED"
    return states.select("url", "category", "seq", F.when(failed, "PENDING").otherwise(F.col("state")).alias("state"), F.when(failed, at).otherwise(F.col("at")).alias("at"))


def reset(states: DataFrame) -> DataFrame:
    return states.limit(0)


def discover(listing: DataFrame, start: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new pending rows, progress) of listing pages (category, page, url; a null url
    for a page without any) read from each category's page in ``start`` up to its first
    empty page. Progress (category, page, state) is the last page that has urls; only
    a category whose empty page was seen is done."""
    rows = listing.join(start.select("category", F.col("page").alias("first")), "category", "left").where(F.col("page") >= F.coalesce("first", F.lit(1)))
    sizes = rows.groupBy("category", "page").agg(F.count("url").alias("n"))
    ends = sizes.groupBy("category").agg(F.min(F.when(F.col("n") == 0, F.col("page"))).alias("end"))
    read = rows.join(ends, "category").where(F.col("end").isNull() | (F.col("page") < F.col("end")))
    found = read.where("url is not null").select("url", "category", F.col("page").alias("seq"))
    new = enqueue(found, states.where("state <> 'PENDING'"), states.where("state = 'PENDING'"))
    progress = ends.join(read.groupBy("category").agg(F.max("page").alias("page")), "category", "left")
    return new, progress.select("category", "page", F.when(F.col("end").isNotNull(), "DISCOVERY_DONE").otherwise("DISCOVERING").alias("state"))


def safe_restart_page(listing: DataFrame, progress: DataFrame, pending: DataFrame) -> DataFrame:
    """category, page: one after the last page, of those up to the progress, whose
    urls (category, page, url) are all pending; else 1."""
    urls = listing.join(progress.select("category", F.col("page").alias("last")), "category").where(F.col("page") <= F.col("last"))
    known = pending.select("url").distinct().withColumn("there", F.lit(True))
    pages = urls.join(known, "url", "left").groupBy("category", "page").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("safe"))
    best = pages.where("safe").groupBy("category").agg(F.max("page").alias("page"))
    return progress.select("category").join(best, "category", "left").select("category", F.coalesce(F.col("page") + 1, F.lit(1)).alias("page"))


def requeue_failed(failed: DataFrame, url_category: DataFrame) -> DataFrame:
    """url, category of failed ids, found by the url's last segment."""
    return url_category.withColumn("id", T.last_segment(F.col("url"))).join(failed.select("id").distinct(), "id").select("url", "category", "id")


def finish(pending: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(done, failed, visited, pending) after results (id, url, ok): each url leaves
    the queue once and is visited."""
    done = results.where("ok").select("id").distinct()
    failed = results.where("not ok").select("id").distinct()
    ranked = pending.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("seq")))
    left = ranked.join(results.select("url").distinct().withColumn("n", F.lit(1)), ["url", "n"], "left_anti").drop("n")
    return done, failed, results.select("url").distinct(), left


def status(visited: DataFrame, pending: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """state, n: the size of each."""
    count = lambda name, df: df.agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("n"))
    return count("visited", visited).union(count("pending", pending)).union(count("done", done)).union(count("failed", failed))


def look_up(keys: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Each key with its value or the default."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def put(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key wins."""
    every = table.unionByName(changes)
    values = [c for c in every.columns if c not in (key, order)]
    best = every.groupBy(key).agg(F.max_by(F.struct(F.lit(1).alias("_"), *values), order).alias("v"), F.max(order).alias(order))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in values], order)


def undiscovered(categories: DataFrame, states: DataFrame) -> DataFrame:
    """Categories whose discovery isn't done."""
    return categories.join(states.where("state = 'DISCOVERY_DONE'").select("url"), "url", "left_anti")


def discovered(page_counts: DataFrame) -> DataFrame:
    """url, state: done only once an empty page was seen (url, page, n_urls)."""
    return page_counts.groupBy("url").agg(F.when(F.bool_or(F.col("n_urls") == 0), "DISCOVERY_DONE").otherwise("DISCOVERING").alias("state"))
