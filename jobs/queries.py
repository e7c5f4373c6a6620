"""The jobs as registered queries: each runs its job twice into one new folder of the
shared one, and gives the whole output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import catalogue_pages, index_documents
from quillgraph.functions import text as T
from quillgraph.operators.state import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark.range(0))}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return index_documents.postings(spark, f"{folder}/index")


def job2_catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        catalogue_pages.run(spark, f"{sf_dir}/pages.parquet", folder)
    pages = spark.read.schema(catalogue_pages.CATALOGUE).parquet(f"{folder}/pages")
    sites = spark.read.parquet(f"{folder}/sites").select("host", F.col("pages").alias("site_pages"), F.col("links").alias("site_links"))
    return pages.join(sites, "host").select("canonical", "page_id", "host", "id", "title", "n_links", "state", "tld", "site_pages", "site_links")


QUERIES = {f.__name__: f for f in (job1_index_documents, job2_catalogue_pages)}

_BLOCKED = " OR ".join(f"contains(lower(html), '{phrase}')" for phrase in T.BLOCK_PHRASES)

ORACLES = {
    "job1_index_documents": r"""
SELECT lang, doc_id, term, count(*) AS tf
FROM (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents)
GROUP BY ALL""",
    "job2_catalogue_pages": f"""
WITH u AS (SELECT page_id, html, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') || '/' AS canonical FROM pages WHERE url IS NOT NULL),
l AS (SELECT canonical, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM u GROUP BY canonical),
p AS (
  SELECT canonical, page_id, lower(regexp_extract(canonical, '^[^:/?#]*://([^/?#]*)', 1)) AS host, split_part(rtrim(canonical, '/'), '/', -1) AS id,
    nullif(trim(replace(replace(replace(replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')), '') AS title,
    len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::BIGINT AS n_links, ({_BLOCKED}) AS blocked FROM l)
SELECT canonical, page_id, host, id, title, n_links, CASE WHEN blocked THEN 'blocked' WHEN title IS NULL THEN 'empty' ELSE 'page' END AS state,
  CASE WHEN host = '' THEN 'none' ELSE split_part(host, '.', -1) END AS tld,
  count(*) OVER (PARTITION BY host) AS site_pages, (sum(n_links) OVER (PARTITION BY host))::BIGINT AS site_links
FROM p""",
}
