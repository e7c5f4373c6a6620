"""Sources: pages, sitemaps, listings, PDF blocks, event queues, tables.

Fetching is outside the engine: its boundary is a table of what was fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T

EVENTS = "seq long, json string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sitemap(xml: DataFrame, col: str = "xml") -> DataFrame:
    """url, category, key of every location whose slug isn't black-listed; name
    spaces don't matter."""
    urls = xml.select(F.explode(F.expr(f"xpath({col}, '//*[local-name()=\"loc\"]/text()')")).alias("url")).select(T.strip(F.col("url")).alias("url"))
    rows = urls.withColumn("slug", T.slug(F.col("url"))).where(~F.lower("slug").isin(*T.SLUG_BLACKLIST))
    label = T.category_label(F.col("slug"))
    return rows.select("url", label.alias("category"), T.category_key(label).alias("key"))


def listing(pages: DataFrame) -> DataFrame:
    """category, page, url, position: document links of the second-level headings of
    listing pages (category, page, html), each once a page, in order."""
    parsed = pages.select("category", "page", H.parse_page(F.col("html"))["headings"].alias("links"))
    good = F.array_distinct(F.transform(F.filter("links", T.is_document_url), T.canonical_url))
    return parsed.select("category", "page", F.posexplode(good).alias("position", "url"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files that are PDFs by their first bytes."""
    return spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "content")


def pdf_markdown(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown, problem from text blocks (doc_id, lang, page, ord, kind, text).

    Kind 0 is text, 1 an image. Article openings become headings. All pages images:
    ``image``; no text: ``empty``; letters of the wrong script: ``encoding``; these
    have no markdown.
    """
    body = T.strip(F.coalesce("text", F.lit("")))
    rows = blocks.select("doc_id", "lang", "page", "ord", "kind", body.alias("text"))
    pages = rows.groupBy("doc_id", "page").agg(F.bool_or(F.col("kind") == 0).alias("has_text"), F.bool_or(F.col("kind") == 1).alias("has_image"))
    images = pages.groupBy("doc_id").agg(F.bool_and(~F.col("has_text") & F.col("has_image")).alias("only_images"))
    line = F.when(F.col("text").rlike(T.ARTICLE_START), F.concat(F.lit("\n## "), F.col("text"))).otherwise(F.col("text"))
    lines = rows.where("kind = 0 and text <> ''").withColumn("line", line)
    raw = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "line"))), lambda s: s["line"]), "\n\n").alias("raw"))
    docs = rows.groupBy("doc_id").agg(F.first("lang").alias("lang")).join(images, "doc_id").join(raw, "doc_id", "left")
    problem = F.when(F.col("only_images"), "image").when(F.col("raw").isNull(), "empty").when(T.is_garbled(F.col("raw"), F.col("lang")), "encoding")
    docs = docs.withColumn("problem", problem)
    docs = docs.join(titles, "doc_id", "left") if titles is not None else docs.withColumn("title", F.lit(""))
    md = T.clean_markdown(F.col("raw"))
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), md)).otherwise(md)
    return docs.select("doc_id", F.when(F.col("problem").isNull(), titled).alias("markdown"), "problem")


def records(pages: DataFrame, english: DataFrame | None = None, pdf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, amendments) of raw pages (url, category, html).

    ``english``: (url, html) of the English pages; ``pdf``: (url, markdown) of
    converted files. A page of an amending category with a relation table is an
    amendment only; one whose table lacks a link gives nothing.
    """
    parsed = pages.withColumn("id", T.last_segment(F.col("url"))).where("id <> ''").select("id", "url", "category", H.parse_page(F.col("html")).alias("p"))
    amends = F.coalesce(T.contains_any(F.col("category"), T.AMENDMENT_MARKS) & (F.col("category") != ""), F.lit(False)) & F.col("p.relation_table")
    edges = parsed.where(amends & F.col("p.source_id").isNotNull()).select("id", F.col("p.source_id").alias("source_id"), F.col("p.target_id").alias("target_id"), F.lit("AMENDS").alias("relation_type"))
    docs = parsed.where(~amends).select("id", "url", "category", "p.*")
    if english is not None:
        en = english.select(F.col("url").alias("url_en"), H.parse_page(F.col("html")).alias("e")).select("url_en", F.col("e.english").alias("en_body"), F.col("e.title").alias("en_title"), F.col("e.has_english").alias("has_en"))
        docs = docs.join(en, "url_en", "left")
    else:
        docs = docs.withColumns({"en_body": F.lit(None).cast("string"), "en_title": F.lit(None).cast("string"), "has_en": F.lit(False)})
    if pdf is not None:
        for lang in ("ar", "en"):
            docs = docs.join(pdf.select(F.col("url").alias(f"pdf_url_{lang}"), F.col("markdown").alias(f"pdf_{lang}")), f"pdf_url_{lang}", "left")
    else:
        docs = docs.withColumns({"pdf_ar": F.lit(None).cast("string"), "pdf_en": F.lit(None).cast("string")})
    page_md = lambda title, body: F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), T.clean_markdown(T.promote_headings(body)))
    ar = F.when(F.col("has_body"), page_md(F.col("title"), F.col("body"))).otherwise(F.col("pdf_ar"))
    en_there = F.coalesce("en_body", F.lit("")) != ""
    en = F.when(en_there, page_md(F.col("en_title"), F.col("en_body"))).otherwise(F.col("pdf_en"))
    docs = docs.withColumns({"contentAr": ar, "contentEn": en})
    issuer = F.coalesce("issuer", T.lookup(F.col("category"), T.ISSUER_BY_CATEGORY))
    return docs.select(
        "id",
        "title",
        F.coalesce("iso_date", T.arabic_date(F.col("date_text"))).alias("date"),
        F.col("category").alias("document_type"),
        issuer.alias("issuer"),
        F.col("url").alias("url_ar"),
        "url_en",
        "pdf_url_ar",
        "pdf_url_en",
        T.content_source(F.col("has_body"), F.col("pdf_url_ar")).alias("ar_source"),
        T.content_source(F.col("has_en"), F.col("pdf_url_en")).alias("en_source"),
        "contentAr",
        "contentEn",
        T.content_status(F.col("contentAr"), F.col("contentEn")).alias("status"),
    ), edges


def event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A folder of JSON lines (seq, json) as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).json(path)
