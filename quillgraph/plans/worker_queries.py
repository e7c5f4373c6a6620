"""Registered queries of what workers do: queues, ingestion, crawl state, stored
indexes, topics, communities. Those that write use new folders in the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import providers
from ..functions import text as T
from ..operators import bm25, crawl, graph, retrieval, upsert, vector
from ..operators.state import shared_dir
from ..sources import inputs, sinks
from ..streaming import workers
from . import queries
from .oracles import CLUSTERS, EDGES, QUERY, TOKENS, VEC, _index, _score

NOW = "2024-05-06T07:08:09"
ARABIC = (*T.ISSUER_KEYWORDS, *T.ARABIC_MONTHS)


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark.range(0))}/{name}-{uuid.uuid4().hex}"


def arabic_text():
    """Arabic words by number, with digits, a comma and Latin words between them."""
    word = lambda n: F.element_at(F.array(*map(F.lit, ARABIC)), (F.pmod(F.col("doc_id") * n, F.lit(len(ARABIC))) + 1).cast("int"))
    return F.concat(word(1), F.lit(" law "), word(5), F.lit("، ٣"), word(7), F.lit(" "), word(1))


def as_nodes(rows):
    """(id, issuer, contentEn, contentAr) as whole documents."""
    return rows.select("id", *[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in upsert.DOCUMENT_FIELDS], "seq")


def queue_roundtrip(spark, d):
    """Envelopes pushed to a queue and read back, and the queue's length before and
    after it is cleared."""
    path = folder(spark, "queue")
    rows = queries.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("issuer"), F.col("text").alias("contentEn"), F.col("doc_id").alias("seq"))
    edges = queries.documents(spark, d).select(F.lit("u").alias("id"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("target_id"), F.lit("AMENDS").alias("relation_type"), (F.col("doc_id") + (1 << 40)).alias("seq"))
    sinks.push_events(upsert.node_event(as_nodes(rows)), path)
    sinks.push_events(upsert.edge_event(edges), path)
    raw = spark.read.schema(inputs.EVENTS).json(path)
    nodes, relations, _ = upsert.read_events(raw)
    found = nodes.agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n"), F.sum(F.length("contentEn")).cast("long").alias("total"))
    found = found.union(relations.where("type = 'AMENDS'").agg(F.lit("edges"), F.count(F.lit(1)), F.sum(F.length("dst")).cast("long")))
    before = sinks.queue_length(spark, path)
    cleared = folder(spark, "queue")
    sinks.push_events(raw, cleared)
    sinks.clear_queue(spark, cleared)
    return found.union(spark.range(1).select(F.lit("length"), F.lit(before).cast("long"), F.lit(sinks.queue_length(spark, cleared)).cast("long")))


def ingested_graph(spark, d):
    """Documents, a later version of every tenth and a relation each (some to documents
    that don't exist, one without a type), and what no one can read, through the
    ingestor: documents with stubs, relations, quarantine."""
    root, queue = folder(spark, "graph"), folder(spark, "queue")
    docs = queries.documents(spark, d)
    first = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("issuer"), F.col("text").alias("contentEn"), F.col("doc_id").alias("seq"))
    later = docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("later").alias("issuer"), F.lit(None).cast("string").alias("contentEn"), (F.col("doc_id") + (1 << 40)).alias("seq"))
    target = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    kind = F.when(F.pmod("doc_id", F.lit(3)) > 0, "AMENDS")
    edges = docs.select(F.lit(None).cast("string").alias("id"), F.col("doc_id").cast("string").alias("source_id"), target.alias("target_id"), kind.alias("relation_type"), F.col("doc_id").alias("seq"))
    other = docs.where("doc_id % 4 = 0").select(F.concat(F.lit('{"type": "other", "payload": {"id": "'), F.col("doc_id").cast("string"), F.lit('"}}')).alias("json"), F.col("doc_id").alias("seq"))
    for events in (upsert.node_event(as_nodes(first)), upsert.node_event(as_nodes(later)), upsert.edge_event(edges), other):
        sinks.push_events(events, queue)
    workers.ingest(spark, queue, root).awaitTermination()
    tables = workers.Tables(spark, root)
    found = tables.read("documents").select(F.lit("document").alias("kind"), "id", "issuer", F.coalesce(F.length("contentEn"), F.lit(-1)).cast("long").alias("n"))
    found = found.union(tables.read("relations").select(F.lit("relation"), F.concat_ws(">", "src", "dst"), "type", F.lit(-1).cast("long")))
    return found.union(tables.read("quarantine").select(F.lit("quarantine"), F.get_json_object("json", "$.payload.id"), F.lit(None).cast("string"), F.lit(-1).cast("long")))


def chunk_worker(spark, d):
    """Conversation turns as documents through the chunk worker, in polls from some 2,000
    on, none long enough to be cut: every chunk with the length of its vector."""
    root = folder(spark, "graph")
    tables = workers.Tables(spark, root, 8)
    rows = inputs.table(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("id"), F.when(F.col("role") == "user", "مرسوم").alias("contentAr"), F.col("text").alias("contentEn"), F.lit(0).cast("long").alias("seq"))
    tables.write("documents", 0, as_nodes(rows), ["id"], workers.latest(["id"]))
    embed = lambda c: providers.embedding(c, providers.HashEmbedder(16))
    workers.catch_up(tables, "polled", "doc_id", lambda share: workers.chunk_poll(tables, None, embed=embed, share=share), 2000)
    return tables.read("chunks").select("id", "doc_id", "language", F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dims"))


def topic_worker(spark, d):
    """All documents through the topic worker: links to topics, each with its vector."""
    root = folder(spark, "graph")
    tables = workers.Tables(spark, root, 8)
    rows = queries.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contentEn"), F.lit(0).cast("long").alias("seq"))
    tables.write("documents", 0, as_nodes(rows), ["id"], workers.latest(["id"]))
    embed = lambda c: providers.embedding(c, providers.HashEmbedder(16))
    workers.follow(lambda: workers.topic_poll(tables, providers.offline_topics, embed, None), 0, once=True)
    return tables.read("has_topic").join(tables.read("topics").select("name", F.size("embedding").cast("long").alias("dims")), "name").select(F.col("doc_id").cast("long").alias("doc_id"), "name", "dims")


def text_embeddings(spark, d):
    rows = queries.documents(spark, d).select("doc_id", F.posexplode(providers.embedding(F.col("text"), providers.HashEmbedder(32))).alias("i", "x"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 4).alias("x")).where("x <> 0")


def stored_index_search(spark, d):
    """A bilingual search over stored indexes: the English documents' and that of an
    Arabic text each document is given, which only Arabic words of the query find."""
    docs = queries.documents(spark, d)
    found = []
    for name, rows, tokens, words in (
        ("en", docs.where("lang = 'en'"), T.tokens(F.col("text")), providers.translate(" ".join(queries.QUERY_TERMS))["en"].split()),
        ("ar", docs.select("doc_id", arabic_text().alias("text")), T.arabic_tokens(F.col("text")), providers.translate(f"{ARABIC[0]} {ARABIC[8]}")["ar"].split()),
    ):
        path = folder(spark, f"index-{name}")
        bm25.build(rows, tokens).save(path)
        found.append((bm25.Index.load(spark, path), queries.terms(spark, words)))
    return bm25.search(found, 50).select("doc_id", F.round("score", 6).alias("score"))


def arabic_token_counts(spark, d):
    tokens = T.arabic_tokens(arabic_text())
    return queries.documents(spark, d).select("doc_id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, "|").alias("tokens"))


def empty_index(spark, d):
    """Searching an index over no documents gives none."""
    index = bm25.build(queries.documents(spark, d).where("lang = 'xx'"), T.tokens(F.col("text")))
    return bm25.search([(index, queries.terms(spark, queries.QUERY_TERMS))], 50).agg(F.count(F.lit(1)).alias("n"))


def crawl_states(spark, d):
    """Pages of a crawl: all are pending, then results move them and failures come back."""
    rows = inputs.table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("seq"))
    none = F.lit(None).cast("string").alias("at")
    states = rows.select("url", F.regexp_extract("url", r"\.(com|net|org)", 1).alias("category"), "seq", F.lit("PENDING").alias("state"), none)
    return states, states.where("seq % 2 = 0").select("url", (F.col("seq") % 3 > 0).alias("ok"))


def crawl_moves(spark, d):
    states, results = crawl_states(spark, d)
    return crawl.move(states, results.union(results), F.lit(NOW))


def crawl_requeued(spark, d):
    states, results = crawl_states(spark, d)
    return crawl.requeue(crawl.move(states, results, F.lit(NOW)), F.lit(NOW))


def crawl_reset(spark, d):
    """How many urls of each category a crawl had, and has after a reset."""
    states = crawl_states(spark, d)[0]
    left = crawl.reset(states).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy("category").agg(F.count(F.lit(1)).alias("before")).join(left, "category", "left").select("category", "before", F.coalesce("n", F.lit(0)).alias("n"))


def queue_range(spark, d):
    """The queue from its hundredth place on."""
    return crawl.queue_range(crawl_states(spark, d)[0], 100).select("seq", "url")


def listings(spark, d):
    """Listing pages by category, ten urls a page; every ninth page is empty."""
    rows = inputs.table(spark, d, "pages").select(F.pmod("page_id", F.lit(3)).cast("string").alias("category"), (F.floor(F.col("page_id") / 30) + 1).alias("page"), "page_id", "url")
    return rows.select("category", "page", F.when(F.pmod("page", F.lit(9)) > 0, F.col("url")).alias("url"))


def discovery(spark, d):
    states, results = crawl_states(spark, d)
    start = spark.range(1).select(F.lit("1").alias("category"), F.lit(2).cast("long").alias("page"))
    return crawl.discover(listings(spark, d), start, crawl.move(states, results, F.lit(NOW)).where("seq % 4 = 0"))


def discovered_urls(spark, d):
    return discovery(spark, d)[0].select("url", "category", "seq")


def discovery_progress(spark, d):
    return discovery(spark, d)[1]


def still_undiscovered(spark, d):
    """Categories that a new run still reads."""
    states = discovery(spark, d)[1].select(F.col("category").alias("url"), "state")
    return crawl.undiscovered(queries.documents(spark, d).select(F.pmod("doc_id", F.lit(5)).cast("string").alias("url")).distinct(), states)


def merge_dry_run(spark, d):
    """What a merge would do: every duplicate with the topic that stays."""
    return queries.clusters(spark, d).where("topic <> canonical").select("root", "canonical", F.col("topic").alias("duplicate"))


def stored_communities(spark, d):
    """Communities written and read back: labels, and how many belong to each."""
    path = folder(spark, "communities")
    docs = queries.documents(spark, d).select("doc_id", F.pmod("doc_id", F.lit(10)).cast("int").alias("community"))
    topics = queries.embeddings(spark, d).select(F.col("vec_id").alias("topic"), F.col("label").alias("community"))
    groups = topics.select("community").where("community is not null").distinct()
    sinks.persist_communities(groups, graph.belongs_to(docs, topics, groups), providers.community_label, path)
    members = spark.read.parquet(f"{path}/belongs_to").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{path}/communities").join(members, "community").select("community", "label", "n")


def written_documents(spark, d):
    """The documents' JSON files, read back: rows and characters by status."""
    path = folder(spark, "json")
    rows = queries.documents(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.col("text")).alias("contentEn"), F.when(F.col("lang") != "en", F.col("text")).alias("contentAr"))
    sinks.write_documents(rows.withColumn("status", T.content_status(F.col("contentAr"), F.col("contentEn"))), path)
    back = spark.read.schema("id long, contentEn string, contentAr string, status string").json(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("contentEn"), F.lit(0)) + F.coalesce(F.length("contentAr"), F.lit(0))).cast("long").alias("chars"))


def simple_contexts(spark, d):
    """The simple search's contexts: a chunk whose document is missing keeps its bare text."""
    rows = queries.documents(spark, d).select(F.col("doc_id").alias("id"), "doc_id", "text")
    known = queries.as_records(spark, d).where("doc_id % 3 > 0")
    edges = queries.has_topic(spark, d).withColumn("topic", F.col("topic").cast("string"))
    return retrieval.expand_simple(rows, known, edges).select("doc_id", F.md5("context").alias("context_md5"))


def query_topic_vector(spark, d):
    """The mean vector of the topics that a query names, and the topics next to it."""
    names = providers.query_topics("seven of the eleven topics")
    rows = queries.embeddings(spark, d).where(F.pmod("vec_id", F.lit(len(names) + 3)) == 0)
    near = vector.nearest(queries.embeddings(spark, d), vector.mean_vector(rows), 20)
    return near.select("vec_id", F.round("score", 6).alias("score"))


def document_communities(spark, d):
    """The community that Louvain gives each document, by the document-topic edges."""
    placed = queries.louvain_communities(spark, d)
    return queries.documents(spark, d).select("doc_id").join(placed, F.col("doc_id") == F.col("node")).select("doc_id", "community")


def stamped_now(spark, d):
    now = T.utc_now()
    return queries.documents(spark, d).select("doc_id", now.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+\+00:00$").alias("iso"), (F.abs(F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp()) < 5).alias("now"))


QUERIES = {
    f.__name__: f
    for f in (
        queue_roundtrip, ingested_graph, chunk_worker, topic_worker, text_embeddings, stored_index_search, arabic_token_counts, empty_index, crawl_moves, crawl_requeued,
        crawl_reset, queue_range, discovered_urls, discovery_progress, still_undiscovered, merge_dry_run, stored_communities, written_documents, simple_contexts,
        query_topic_vector, document_communities, stamped_now,
    )
}

_WORD = lambda n: f"[{', '.join(repr(w) for w in ARABIC)}][(doc_id * {n}) % {len(ARABIC)} + 1]"
ARABIC_TEXT = f"{_WORD(1)} || ' law ' || {_WORD(5)} || '، ٣' || {_WORD(7)} || ' ' || {_WORD(1)}"
ARABIC_TOKENS = f"regexp_extract_all({ARABIC_TEXT}, '[\\x{{0600}}-\\x{{06FF}}]+')"
TOPICS = f"""w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE length(term) > 3 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
top AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(((SELECT count(*) FROM documents) + 1) / df), 9) DESC, term) AS r FROM w JOIN df USING (term) QUALIFY r <= 7)"""
STATES = """rows_ AS (SELECT url, regexp_extract(url, '\\.(com|net|org)', 1) AS category, min(page_id) AS seq FROM pages GROUP BY ALL),
moved AS (SELECT *, CASE WHEN seq % 2 = 1 THEN 'PENDING' WHEN seq % 3 > 0 THEN 'DONE' ELSE 'FAILED' END AS state FROM rows_)"""
DISCOVERY = f"""{STATES}, listing AS (SELECT (page_id % 3)::VARCHAR AS category, page_id // 30 + 1 AS page, url FROM pages),
open_ AS (SELECT *, page % 9 > 0 AS there FROM listing WHERE page >= CASE WHEN category = '1' THEN 2 ELSE 1 END),
ends AS (SELECT category, min(page) FILTER (NOT there) AS last FROM open_ GROUP BY category),
seen AS (SELECT open_.* FROM open_ JOIN ends USING (category) WHERE last IS NULL OR page < last)"""

ORACLES = {
    "queue_roundtrip": """SELECT 'nodes' AS what, count(*) AS n, sum(length(text))::BIGINT AS total FROM documents
UNION ALL SELECT 'edges', count(*), sum(length(source))::BIGINT FROM documents UNION ALL SELECT 'length', 2 * count(*), 0 FROM documents""",
    "ingested_graph": """SELECT 'document' AS kind, doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 = 0 THEN 'later' ELSE source END AS issuer, CASE WHEN doc_id % 10 > 0 THEN length(text) ELSE -1 END AS n FROM documents
UNION ALL SELECT 'document', 'x' || doc_id, NULL, -1 FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'relation', doc_id || '>' || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || doc_id, CASE WHEN doc_id % 3 > 0 THEN 'AMENDS' ELSE 'REFERENCES' END, -1 FROM documents
UNION ALL SELECT 'quarantine', doc_id::VARCHAR, NULL, -1 FROM documents WHERE doc_id % 4 = 0""",
    "chunk_worker": """SELECT conv_id || '.' || turn || CASE WHEN role = 'user' THEN '-ar-0' ELSE '-en-0' END AS id, conv_id || '.' || turn AS doc_id, CASE WHEN role = 'user' THEN 'ar' ELSE 'en' END AS language,
  md5(CASE WHEN role = 'user' THEN 'مرسوم' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS text_md5, 16::BIGINT AS dims FROM conversations WHERE role = 'user' OR trim(text) <> ''""",
    "topic_worker": f"WITH {TOPICS} SELECT doc_id, term AS name, 16::BIGINT AS dims FROM top",
    "text_embeddings": f"""WITH w AS (SELECT doc_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [' '] END) AS word FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
h AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 32 AS i, CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT >= 8 THEN 1 ELSE -1 END AS s FROM w),
v AS (SELECT doc_id, i, sum(s)::DOUBLE AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id)
SELECT doc_id, i, round((x / n)::FLOAT::DOUBLE, 4) AS x FROM v JOIN n USING (doc_id) WHERE n > 0 AND round((x / n)::FLOAT::DOUBLE, 4) <> 0""",
    "stored_index_search": f"""WITH {_index("e", "WHERE lang = 'en'")}, {_score("e", QUERY)}, {_index("r", "").replace(TOKENS, ARABIC_TOKENS)}, {_score("r", f"'{ARABIC[0]}', '{ARABIC[8]}'")},
best AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM en UNION ALL SELECT * FROM rn) GROUP BY doc_id HAVING max(score) > 0)
SELECT doc_id, round(score, 6) AS score FROM best ORDER BY best.score DESC, doc_id LIMIT 50""",
    "arabic_token_counts": f"SELECT doc_id, len({ARABIC_TOKENS})::BIGINT AS n, array_to_string({ARABIC_TOKENS}, '|') AS tokens FROM documents",
    "empty_index": "SELECT 0::BIGINT AS n",
    "crawl_moves": f"WITH {STATES} SELECT url, category, seq, state, CASE WHEN state <> 'PENDING' THEN '{NOW}' END AS at FROM moved",
    "crawl_requeued": f"WITH {STATES} SELECT url, category, seq, replace(state, 'FAILED', 'PENDING') AS state, CASE WHEN state <> 'PENDING' THEN '{NOW}' END AS at FROM moved",
    "crawl_reset": "SELECT regexp_extract(url, '\\.(com|net|org)', 1) AS category, count(DISTINCT url) AS before, 0::BIGINT AS n FROM pages GROUP BY 1",
    "queue_range": f"WITH {STATES} SELECT seq, url FROM rows_ ORDER BY seq, url OFFSET 100",
    "discovered_urls": f"""WITH {DISCOVERY} SELECT url, arg_min(category, page) AS category, min(page) AS seq FROM seen WHERE url NOT IN (SELECT url FROM moved WHERE seq % 4 = 0) GROUP BY url""",
    "discovery_progress": f"WITH {DISCOVERY} SELECT category, (SELECT max(page) FROM seen WHERE seen.category = ends.category) AS page, CASE WHEN last IS NULL THEN 'DISCOVERING' ELSE 'DISCOVERY_DONE' END AS state FROM ends",
    "still_undiscovered": f"WITH {DISCOVERY} SELECT DISTINCT (doc_id % 5)::VARCHAR AS url FROM documents WHERE (doc_id % 5)::VARCHAR NOT IN (SELECT category FROM ends WHERE last IS NOT NULL)",
    "merge_dry_run": f"WITH RECURSIVE {CLUSTERS} SELECT root, canonical, topic AS duplicate FROM canon WHERE topic <> canonical",
    "stored_communities": """WITH g AS (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL), m AS (SELECT doc_id % 10 AS label FROM documents UNION ALL SELECT label FROM embeddings)
SELECT g.label AS community, 'Community ' || g.label AS label, count(*) AS n FROM g JOIN m ON m.label = g.label GROUP BY g.label""",
    "written_documents": """SELECT CASE WHEN coalesce(text, '') = '' THEN 'EMPTY_CONTENT' WHEN lang = 'en' THEN 'ONLY_ENGLISH' ELSE 'ONLY_ARABIC' END AS status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL""",
    "simple_contexts": f"""WITH {EDGES} SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 THEN '[Document: ' || 'Document ' || doc_id || ' | Issuer: ' || source || ' | ? | ' || lang || ']' || chr(10) || '[Topics: ' || topic || ']' || chr(10) || chr(10) ELSE '' END || text) AS context_md5
FROM documents JOIN edges USING (doc_id)""",
    "query_topic_vector": f"""WITH {VEC}, parts AS (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v WHERE vec_id % 6 = 0) GROUP BY i),
m AS (SELECT list(x ORDER BY i) AS q FROM parts), s AS (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM v, m ORDER BY s DESC, vec_id LIMIT 20)
SELECT vec_id, round(s, 6) AS score FROM s""",
    "document_communities": "SELECT doc_id, -(doc_id % (SELECT count(*) FROM embeddings)) - 1 AS community FROM documents",
    "stamped_now": "SELECT doc_id, true AS iso, true AS now FROM documents",
}
