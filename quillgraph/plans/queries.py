"""The registered queries: each operator on whole tables of the test data.

The tables stand in for the document graph: ``embeddings`` rows are topics and
chunk vectors, a document is linked to topic ``doc_id mod number of topics``,
``events`` and ``orders`` are upserts, ``pages`` the crawl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import html as H
from ..functions import text as T
from ..operators import bm25, chunk, crawl, graph, retrieval, upsert, vector
from ..operators.state import spread
from ..sources import inputs

QUERY_TERMS = ("the", "and", "tion", "of", "the", "oure")
OTHER_TERMS = ("le", "und", "con", "ment")
SIMILAR = 0.40


def terms(spark: SparkSession, words) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("term"))


def documents(spark, d):
    return inputs.table(spark, d, "documents")


def embeddings(spark, d):
    return inputs.table(spark, d, "embeddings")


def pages(spark, d):
    return spread(inputs.table(spark, d, "pages"))


def english_index(spark, d):
    return bm25.build(documents(spark, d).where("lang = 'en'"), T.tokens(F.col("text")))


def other_index(spark, d):
    return bm25.build(documents(spark, d).where("lang <> 'en'"), T.tokens(F.col("text")))


def first_vector(spark, d):
    """The query vector: the embedding of the smallest id."""
    return embeddings(spark, d).agg(F.min_by("embedding", "vec_id").alias("query_vec"))


def has_topic(spark, d):
    n = F.broadcast(embeddings(spark, d).agg(F.count(F.lit(1)).alias("n")))  # one row
    return documents(spark, d).crossJoin(n).select("doc_id", F.pmod("doc_id", "n").alias("topic"))


def tokenize_counts(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_distinct"))


def bm25_doc_stats(spark, d):
    index = english_index(spark, d)
    return bm25.stats(index).select("n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("mean_idf", 6).alias("mean_idf"))


def bm25_idf_floor(spark, d):
    return bm25.idf(english_index(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return bm25.search([(english_index(spark, d), terms(spark, QUERY_TERMS))], 50).select("doc_id", F.round("score", 6).alias("score"))


def bm25_bilingual_best(spark, d):
    found = bm25.search([(english_index(spark, d), terms(spark, QUERY_TERMS)), (other_index(spark, d), terms(spark, OTHER_TERMS))], 50)
    return found.select("doc_id", F.round("score", 6).alias("score"))


def bm25_query_batch(spark, d):
    """Every benchmark item as a query, ten documents each."""
    index = bm25.build(documents(spark, d), T.tokens(F.col("text")))
    asked = inputs.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return bm25.search_many(index, asked, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def dense_topk_cosine(spark, d):
    return vector.nearest(embeddings(spark, d), first_vector(spark, d), 50).select("vec_id", F.round("score", 6).alias("score"))


def dense_topk_l2(spark, d):
    return vector.nearest(embeddings(spark, d), first_vector(spark, d), 50, "l2sq").select("vec_id", F.round("score", 6).alias("score"))


def dense_topk_batch(spark, d):
    """The mean vector of each label as a query, ten neighbours each."""
    asked = vector.mean_vector(embeddings(spark, d), by=("label",)).withColumnRenamed("label", "query_id")
    return vector.nearest_many(embeddings(spark, d), asked, 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def query_vector_mean(spark, d):
    mean = vector.mean_vector(embeddings(spark, d))
    return mean.select(F.posexplode("query_vec").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def topic_search(spark, d):
    """Topics nearest to the mean vector, and each document's best of them."""
    near = vector.nearest(embeddings(spark, d), vector.mean_vector(embeddings(spark, d)), 50).withColumnRenamed("vec_id", "topic")
    return retrieval.topic_scores(near, has_topic(spark, d))


def topic_search_docs(spark, d):
    return topic_search(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def fused(spark, d):
    near = vector.nearest(embeddings(spark, d), first_vector(spark, d), 50)
    dense = near.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("doc_id"), "score")
    sparse = bm25.search([(english_index(spark, d), terms(spark, QUERY_TERMS)), (other_index(spark, d), terms(spark, OTHER_TERMS))], 50)
    return retrieval.fuse(dense, sparse, bm25.normalised(topic_search(spark, d)), 50)


def hybrid_fusion(spark, d):
    return fused(spark, d).select("id", "doc_id", *[F.round(c, 6).alias(c) for c in ("chunk_score", "bm25_score", "topic_score", "score")])


def as_records(spark, d):
    return documents(spark, d).select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("issuer"), F.lit(None).cast("string").alias("date"), F.col("lang").alias("document_type"))


def expand_context(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "doc_id", "text")
    return retrieval.expand(rows, as_records(spark, d), has_topic(spark, d).withColumn("topic", F.col("topic").cast("string"))).select("doc_id", F.md5(F.col("context")).alias("context_md5"), F.length("context").cast("long").alias("context_length"))


def retrieval_metrics(spark, d):
    """Labelled documents of each language, longest first; relevant is quality 1."""
    rows = documents(spark, d).join(inputs.table(spark, d, "labels"), "doc_id").select("lang", "doc_id", "n_chars", F.col("quality").cast("double").alias("rerank_score"))
    found = retrieval.metrics_of(rows, 5, "lang", F.col("n_chars"), "doc_id")
    return found.select("lang", *[F.round(c, 6).alias(c) for c in ("mrr", "precision", "recall")], "candidates", "relevant")


def pairs(spark, d):
    return vector.similar_pairs(embeddings(spark, d), SIMILAR)


def similar_pairs(spark, d):
    return pairs(spark, d).select("a", "b", F.round("sim", 6).alias("sim"))


def topic_components(spark, d):
    found = graph.components(pairs(spark, d).select(F.col("a").alias("x"), F.col("b").alias("y")))
    return found.select(F.col("node").alias("topic"), "root")


def clusters(spark, d):
    topics = embeddings(spark, d).select(F.col("vec_id").alias("topic"))
    return graph.merge_clusters(pairs(spark, d), graph.degree(topics, has_topic(spark, d), "topic", "topic"))


def topic_canonical(spark, d):
    return clusters(spark, d).where("topic = canonical").select("root", "canonical")


def topic_contract(spark, d):
    return graph.contract(has_topic(spark, d), clusters(spark, d))


def topics_left(spark, d):
    return graph.without_merged(embeddings(spark, d).select(F.col("vec_id").alias("topic")), clusters(spark, d))


def merge_report(spark, d):
    before = embeddings(spark, d).agg(F.count(F.lit(1)).alias("before"))
    after = topics_left(spark, d).agg(F.count(F.lit(1)).alias("after"))
    gone = F.col("before") - F.col("after")
    return before.crossJoin(after).select("before", "after", gone.alias("removed"), F.round(F.when(F.col("before") > 0, gone / F.col("before") * 100).otherwise(0.0), 6).alias("percent"))


def greedy_merge(spark, d):
    return graph.greedy_merge(pairs(spark, d))


def detach_delete(spark, d):
    """Edges left when every merged topic is deleted with its edges."""
    topics = embeddings(spark, d).select(F.col("vec_id").alias("topic"))
    gone = clusters(spark, d).where("topic <> canonical").select("topic")
    return graph.detach_delete(topics, has_topic(spark, d), gone, "topic", "topic")[1].select("doc_id", "topic")


def louvain_communities(spark, d):
    """Communities of the document-topic graph; topics are negative nodes."""
    return graph.louvain(has_topic(spark, d).select(F.col("doc_id").alias("x"), (-F.col("topic") - 1).alias("y"), F.lit(1.0).alias("w")))


def graph_stats(spark, d):
    count = lambda name, df: df.agg(F.lit(name).alias("label"), F.count(F.lit(1)).alias("n"))
    return count("document", documents(spark, d)).union(count("topic", embeddings(spark, d))).union(count("has_topic", has_topic(spark, d)))


def topic_edge_counts(spark, d):
    return graph.degree(embeddings(spark, d).select(F.col("vec_id").alias("topic")), has_topic(spark, d), "topic", "topic")


def most_linked_topics(spark, d):
    return topic_edge_counts(spark, d).orderBy(F.desc("edges"), "topic").limit(10)


def topics_by_label(spark, d):
    """The first topics of each community (label), gathered in order, and their number."""
    rows = embeddings(spark, d)
    first = graph.first_of_each(rows, "label", "vec_id", 20).select("label", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("topics"))
    return first.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("label", "topics", "n")


def community_counts(spark, d):
    return embeddings(spark, d).agg(F.count_distinct("label").alias("communities"))


def belongs_to(spark, d):
    docs = documents(spark, d).select("doc_id", F.pmod("doc_id", F.lit(10)).cast("int").alias("community"))
    topics = embeddings(spark, d).select(F.col("vec_id").alias("topic"), F.col("label").alias("community"))
    return graph.belongs_to(docs, topics, embeddings(spark, d).select(F.col("label").alias("community")))


def unchunked_docs(spark, d):
    return upsert.unprocessed(documents(spark, d).where(T.has_text(F.col("text"))), inputs.table(spark, d, "labels"), "doc_id").select("doc_id")


def untopiced_docs(spark, d):
    """One poll of the topic worker: the first 100 documents without a topic."""
    return upsert.unprocessed(documents(spark, d), inputs.table(spark, d, "labels").where("quality = 1"), "doc_id", 100).select("doc_id")


def ingest_latest(spark, d):
    rows = inputs.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "props")
    return upsert.latest_by_key(rows, ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value", "props")


def ingest_edges_stubs(spark, d):
    """Order-part edges whose part isn't in the table of parts that suppliers sell cheap."""
    edges = inputs.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    docs = inputs.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return upsert.stubs(docs, edges)


def ingest_edges(spark, d):
    """One edge for each customer and priority, of the last order's status."""
    rows = inputs.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("seq"))
    return upsert.merge(None, rows, ["src", "dst"])


def events_json(spark, d):
    rows = inputs.table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").cast("long").alias("total"))


def event_envelopes(spark, d):
    """Events sent as envelopes, read back and merged."""
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), *[F.lit(None).cast("string").alias(f) if f not in ("issuer", "contentEn") else F.col({"issuer": "source", "contentEn": "text"}[f]).alias(f) for f in upsert.DOCUMENT_FIELDS])
    raw = upsert.node_event(docs).withColumn("seq", F.xxhash64("json"))
    nodes, _, _ = upsert.read_events(raw)
    return upsert.merge(None, nodes, ["id"]).select("id", "issuer", F.md5("contentEn").alias("content_md5"))


def known_vectors(spark, d):
    """Topics upserted by name: a fresh vector (the old one turned by a place) counts,
    none leaves the old one."""
    old = embeddings(spark, d).select("vec_id", "embedding")
    turned = F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", 1, 1))
    new = embeddings(spark, d).select("vec_id", F.when((F.col("label") < 5) & F.get("embedding", F.lit(1)).isNotNull(), turned).alias("embedding"))
    return upsert.keep_known(new, old, "vec_id", "embedding")


def keep_known_vectors(spark, d):
    """Whole vectors upserted, a row a component."""
    return known_vectors(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def link_topics(spark, d):
    found = has_topic(spark, d)
    return upsert.link(found.union(found), inputs.table(spark, d, "labels"), embeddings(spark, d).where("label < 5").select(F.col("vec_id").alias("topic")))


def duplicate_keys(spark, d):
    return upsert.duplicate_keys(inputs.table(spark, d, "conversations"), "conv_id")


def status_classification(spark, d):
    """Sources as documents: English and other texts, told apart by what there is."""
    en = F.max(F.when(F.col("lang") == "en", F.col("text")))
    ar = F.max(F.when(F.col("lang") == "fr", F.col("text")))
    rows = documents(spark, d).groupBy("source", F.col("n_chars").alias("size")).agg(en.alias("en"), ar.alias("ar"))
    return rows.select("source", "size", T.content_status(F.col("ar"), F.col("en")).alias("status"), T.content_source(F.coalesce("ar", F.lit("")) != "", F.col("en")).alias("origin"))


def lang_stats(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.count_if(~T.has_text(F.col("text"))).alias("skipped"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


def letter_shares(spark, d):
    return documents(spark, d).select("doc_id", F.round(T.letter_share(F.col("text"), "A-Za-z"), 6).alias("latin"), T.is_garbled(F.col("text"), F.lit("AR")).alias("garbled_ar"), T.is_garbled(F.col("text"), F.lit("EN")).alias("garbled_en"))


def chunk_rows(spark, d):
    return documents(spark, d).select("doc_id", F.lit(None).cast("string").alias("contentAr"), F.col("text").alias("contentEn"))


def chunks_per_doc(spark, d):
    return chunk.chunks(chunk_rows(spark, d)).groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_embeddings(spark, d):
    rows = chunk.chunks(chunk_rows(spark, d))
    return rows.select("id", "doc_id", providers.embedding(F.col("text"), providers.HashEmbedder(64)).alias("embedding"))


def page_titles(spark, d):
    return pages(spark, d).select("page_id", H.parse_page(F.col("html"))["title"].alias("title"))


def page_links(spark, d):
    return pages(spark, d).select("page_id", H.parse_page(F.col("html"))["links"].alias("links")).select("page_id", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


def page_markdown(spark, d):
    return pages(spark, d).select("page_id", H.to_markdown(F.col("html")).alias("markdown"))


def page_records(spark, d):
    docs, _ = inputs.records(pages(spark, d).select("url", F.lit("royal decree").alias("category"), "html"))
    return docs


def blocked_pages(spark, d):
    return pages(spark, d).select("page_id", T.is_blocked(F.col("html")).alias("blocked"), T.is_noise(F.col("html")).alias("noise"))


def url_ids(spark, d):
    url = F.col("url")
    return pages(spark, d).select("page_id", T.last_segment(url).alias("id"), T.slug(url).alias("slug"), T.is_document_url(url).alias("is_document"))


def url_normalised(spark, d):
    return pages(spark, d).select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.listing_url(F.col("url"), F.lit(1)).alias("first"), T.listing_url(F.col("url"), F.lit(3)).alias("third"))


def category_labels(spark, d):
    label = T.category_label(F.col("source"))
    return documents(spark, d).select("source").distinct().select("source", label.alias("label"), T.category_key(label).alias("key"))


def crawl_rows(spark, d):
    """Pages as a crawl: fragment urls are pending, urls with a query visited."""
    rows = pages(spark, d).select(F.col("page_id").alias("seq"), "url", F.regexp_extract("url", r"\.(com|net|org)", 1).alias("category"))
    return rows, rows.where(F.col("url").contains("?")), rows.where(F.col("url").contains("#"))


def enqueue_new(spark, d):
    rows, visited, pending = crawl_rows(spark, d)
    return crawl.enqueue(rows.union(rows), visited, pending).select("url", "category", "seq")


def safe_restart_page(spark, d):
    rows, visited, pending = crawl_rows(spark, d)
    listing = rows.select("category", F.floor(F.col("seq") / 3).alias("page"), "url")
    progress = listing.groupBy("category").agg(F.max("page").alias("page"))
    return crawl.safe_restart_page(listing, progress, visited.union(pending))


def requeue_failed(spark, d):
    rows, visited, _ = crawl_rows(spark, d)
    failed = visited.select(T.last_segment(F.col("url")).alias("id"))
    return crawl.requeue_failed(failed, rows.select("url", "category"))


def crawl_status(spark, d):
    rows, visited, pending = crawl_rows(spark, d)
    return crawl.status(visited, pending, rows.where("category = 'com'"), rows.where("category = 'net'"))


def finish_urls(spark, d):
    """The queue after every visited page has left it."""
    rows, visited, pending = crawl_rows(spark, d)
    results = pending.where("category = 'com'").select(T.last_segment(F.col("url")).alias("id"), "url", F.lit(True).alias("ok"))
    return crawl.finish(pending, results)[3].select("seq", "url")


def category_progress(spark, d):
    rows, _, _ = crawl_rows(spark, d)
    old = rows.where("false").select("category", "url", "seq")
    return crawl.put(old, rows.select("category", "url", "seq"), "category", "seq")


def category_state(spark, d):
    rows, visited, _ = crawl_rows(spark, d)
    last = visited.groupBy("category").agg(F.max("seq").alias("page"))
    return crawl.look_up(rows.select("category").distinct(), last, "category", "page", 0)


def community_prompt(spark, d):
    docs = documents(spark, d).select(F.col("source").alias("community"), F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(" "), F.col("source")).alias("title"))
    topics = documents(spark, d).select(F.col("source").alias("community"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("topic"))
    return retrieval.community_prompt(graph.community_members(docs, topics))


def answer_prompt(spark, d):
    """The excerpts of the ten best documents, as an answering model is given them."""
    best = bm25.search([(english_index(spark, d), terms(spark, QUERY_TERMS))], 10)
    rows = retrieval.ranked(best.join(documents(spark, d), "doc_id").select(F.col("doc_id").alias("id"), "score", F.col("text").alias("context")))
    return retrieval.context_block(rows).select(providers.answer_prompt(" ".join(QUERY_TERMS), F.col("context")).alias("prompt"))


def display_candidates(spark, d):
    rows = fused(spark, d).join(documents(spark, d).select("doc_id", "text"), "doc_id").select("id", "doc_id", F.round("score", 6).alias("score"), "text")
    return retrieval.display(rows)


def reranked(spark, d):
    """Fused candidates with context, reranked offline, the five best."""
    rows = fused(spark, d).join(documents(spark, d).select("doc_id", "text"), "doc_id")
    expanded = retrieval.expand(rows, as_records(spark, d), has_topic(spark, d).withColumn("topic", F.col("topic").cast("string")))
    best = retrieval.rerank(expanded, providers.rerank_score(" ".join(QUERY_TERMS), F.col("context"), providers.OverlapReranker()), 5)
    return best.select("id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def score_stats(spark, d):
    found = vector.nearest(embeddings(spark, d), first_vector(spark, d), 50)
    return found.agg(F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"), F.round(F.avg("score"), 6).alias("mean"))


def offline_topics(spark, d):
    found = providers.offline_topics(documents(spark, d))
    return found.select("doc_id", F.array_join("topics", " ").alias("topics"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, bm25_doc_stats, bm25_idf_floor, bm25_topk, bm25_bilingual_best, bm25_query_batch, dense_topk_cosine, dense_topk_l2, dense_topk_batch,
        query_vector_mean, topic_search_docs, hybrid_fusion, expand_context, retrieval_metrics, similar_pairs, topic_components, topic_canonical, topic_contract,
        topics_left, merge_report, greedy_merge, detach_delete, louvain_communities, graph_stats, topic_edge_counts, most_linked_topics, topics_by_label,
        community_counts, belongs_to, unchunked_docs, untopiced_docs, ingest_latest, ingest_edges_stubs, ingest_edges, events_json, event_envelopes,
        keep_known_vectors, link_topics, duplicate_keys, status_classification, lang_stats, letter_shares, chunks_per_doc, chunk_embeddings, page_titles,
        page_links, page_markdown, page_records, blocked_pages, url_ids, url_normalised, category_labels, enqueue_new, safe_restart_page, requeue_failed,
        crawl_status, finish_urls, category_progress, category_state, community_prompt, answer_prompt, display_candidates, reranked, score_stats, offline_topics,
    )
}
