"""A catalogue of crawled pages, and what each site has of them.

    python -m jobs.catalogue_pages --config jobs/catalogue_pages.json \
        --pages <table> --output <folder>

Reads raw pages (page_id, url, html) and writes

    <output>/pages/tld=..   one row a canonical url: its last page, host, id, title, links, state
    <output>/sites/tld=..   by host: pages, how many are blocked or empty, links

The canonical url has neither query nor fragment and one slash at its end; of the pages
of one the greatest page_id counts. The state is ``blocked`` (the server answered with a
block page), ``empty`` (no title), or ``page``. A page without a url has no place in the
catalogue; the log says how many there are. Both tables are made anew from the whole
input by each run, so a run after a failure, or a second one, leaves the same.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from quillgraph.functions import html as H
from quillgraph.functions import text as T
from quillgraph.operators import upsert
from quillgraph.operators.state import spread

PATHS = ("pages", "output")
DEFAULTS = {"id": "page_id", "url": "url", "html": "html"}
CATALOGUE = "canonical string, page_id long, host string, id string, title string, n_links long, state string, tld string"


def bare_url(url: Column) -> Column:
    return T.canonical_url(F.regexp_extract(url, r"^([^?#]*)", 1))


def host_of(url: Column) -> Column:
    """Lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))


def catalogue(pages: DataFrame) -> DataFrame:
    """``CATALOGUE`` of pages (page_id, url, html). Only the pages that count are parsed."""
    rows = pages.where("url is not null").withColumn("canonical", bare_url(F.col("url")))
    last = upsert.latest_by_key(rows.withColumn("at", F.struct("page_id", "url", "html")), ["canonical"], "at")
    parsed = last.withColumn("page", H.parse_page(F.col("html")))
    title = F.nullif(T.strip(F.coalesce("page.title", F.lit(""))), F.lit(""))
    state = F.when(F.coalesce(T.is_blocked(F.col("html")), F.lit(False)), "blocked").when(title.isNull(), "empty").otherwise("page")
    host = host_of(F.col("canonical"))
    tld = F.when(host == "", F.lit("none")).otherwise(F.substring_index(host, ".", -1))
    return parsed.select("canonical", "page_id", host.alias("host"), T.last_segment(F.col("canonical")).alias("id"), title.alias("title"), F.size("page.links").cast("long").alias("n_links"), state.alias("state"), tld.alias("tld"))


def sites(pages: DataFrame) -> DataFrame:
    state = lambda name: F.count_if(F.col("state") == name)
    return pages.groupBy("tld", "host").agg(F.count(F.lit(1)).alias("pages"), state("blocked").alias("blocked"), state("empty").alias("empty"), F.sum("n_links").alias("links"))


def run(spark: SparkSession, pages: str, output: str, config: dict | None = None) -> dict:
    """Gives the numbers of rows read and written."""
    config = DEFAULTS | (config or {})
    raw = spark.read.parquet(pages).select(F.col(config["id"]).cast("long").alias("page_id"), F.col(config["url"]).cast("string").alias("url"), F.col(config["html"]).cast("string").alias("html"))
    read, n_read = counted(spread(raw), "read", F.count_if(F.col("url").isNull()).alias("without_url"))
    made, n_made = counted(catalogue(read), "pages")
    made.write.mode("overwrite").partitionBy("tld").parquet(f"{output}/pages")
    by_site, n_sites = counted(sites(spark.read.schema(CATALOGUE).parquet(f"{output}/pages")), "sites")
    by_site.write.mode("overwrite").partitionBy("tld").parquet(f"{output}/sites")
    done = {"read": n_read.get["rows"], "without_url": n_read.get["without_url"], "pages": n_made.get["rows"], "sites": n_sites.get["rows"]}
    log.info("%s: read %d pages, %d without a url; wrote %d pages of %d sites to %s", pages, done["read"], done["without_url"], done["pages"], done["sites"], output)
    return done


if __name__ == "__main__":
    main(run, PATHS, DEFAULTS, sys.argv[1:])
