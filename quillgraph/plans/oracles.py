"""DuckDB SQL that gives the same rows as the registered queries.

The splitter and the HTML-to-Markdown writer can't be said in SQL; tests hold them
against plain versions.
"""

from __future__ import annotations

from ..functions import text as T

QUERY = "'the', 'and', 'tion', 'of', 'the', 'oure'"
OTHER = "'le', 'und', 'con', 'ment'"
WORD = r"'[\p{L}\p{N}_]+'"
TOKENS = f"regexp_extract_all(lower(text), {WORD})"


def _index(p: str, where: str) -> str:
    """CTEs of an index, prefixed."""
    return f"""
{p}tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents {where}),
{p}post AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}docs AS (SELECT doc_id, count(*) AS len FROM {p}tok GROUP BY ALL),
{p}terms AS (SELECT term, count(*) AS df FROM {p}post GROUP BY ALL),
{p}one AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM {p}docs),
{p}raw AS (SELECT term, df, n_docs, avg_len, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM {p}terms, {p}one),
{p}mean AS (SELECT avg(idf) AS mean_idf FROM {p}raw),
{p}idf AS (SELECT term, df, avg_len, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM {p}raw, {p}mean)"""


def _score(p: str, terms: str) -> str:
    """CTEs of normalised scores for a query's terms."""
    return f"""
{p}q AS (SELECT unnest([{terms}]) AS term),
{p}s AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM {p}q JOIN {p}idf USING (term) JOIN {p}post USING (term) JOIN {p}docs USING (doc_id) GROUP BY ALL),
{p}n AS (SELECT doc_id, CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE score END AS score FROM {p}s)"""


EN = _index("e", "WHERE lang = 'en'")
OT = _index("x", "WHERE lang <> 'en'")
VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
FIRST = "f AS (SELECT arg_min(e, vec_id) AS q FROM v)"
MEAN = """parts AS (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY i),
m AS (SELECT list(x ORDER BY i) AS q FROM parts)"""
EDGES = "edges AS (SELECT doc_id, doc_id % (SELECT count(*) FROM embeddings) AS topic FROM documents)"
PAIRS = f"""{VEC}, pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS sim FROM v x JOIN v y ON x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.40)"""
COMPONENTS = """both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
comp AS (SELECT a AS topic, least(a, min(b)) AS root FROM reach GROUP BY a)"""
CLUSTERS = f"""{PAIRS}, {COMPONENTS}, {EDGES},
deg AS (SELECT topic, count(edges.doc_id) AS n FROM comp LEFT JOIN edges USING (topic) GROUP BY topic),
canon AS (SELECT topic, root, first_value(topic) OVER (PARTITION BY root ORDER BY n DESC, topic) AS canonical FROM comp JOIN deg USING (topic))"""
TOPIC = f"""{MEAN}, near AS (SELECT vec_id AS topic, list_cosine_similarity(e, q) AS score FROM v, m ORDER BY score DESC, topic LIMIT 50),
{EDGES}, topics AS (SELECT doc_id, max(score) AS score FROM edges JOIN near USING (topic) GROUP BY doc_id)"""
FUSED = f"""{EN}, {_score("e", QUERY)}, {OT}, {_score("x", OTHER)},
best AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM en UNION ALL SELECT * FROM xn) GROUP BY doc_id HAVING max(score) > 0 ORDER BY score DESC, doc_id LIMIT 50),
{VEC}, {FIRST}, dense AS (SELECT vec_id AS id, vec_id AS doc_id, list_cosine_similarity(e, q) AS score FROM v, f ORDER BY score DESC, id LIMIT 50),
{TOPIC}, tn AS (SELECT doc_id, CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE score END AS score FROM topics),
dn AS (SELECT id, doc_id, CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE score END AS score FROM dense),
fused AS (SELECT id, dn.doc_id, dn.score AS chunk_score, coalesce(best.score, 0.0) AS bm25_score, coalesce(tn.score, 0.0) AS topic_score,
    0.2 * coalesce(best.score, 0.0) + 0.6 * dn.score + 0.2 * coalesce(tn.score, 0.0) AS score
  FROM dn LEFT JOIN best USING (doc_id) LEFT JOIN tn USING (doc_id) ORDER BY score DESC, id LIMIT 50)"""
LAST = "split_part(rtrim(url, '/'), '/', -1)"
CANON = "rtrim(url, '/') || '/'"
CRAWL = """rows_ AS (SELECT page_id AS seq, url, regexp_extract(url, '\\.(com|net|org)', 1) AS category FROM pages),
visited AS (SELECT * FROM rows_ WHERE contains(url, '?')), pending AS (SELECT * FROM rows_ WHERE contains(url, '#'))"""


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def _map(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


LABEL = f"coalesce({_map('source', T.SLUG_LABELS)}, replace(source, '-', ' '))"
LATIN = r"(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::DOUBLE / nullif(length(text) - length(regexp_replace(text, '\p{L}', '', 'g')), 0)"
ARABIC = r"(length(text) - length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '[\x{0600}-\x{06FF}]', '', 'g')) - (length(text) - length(regexp_replace(text, '[^\p{L}]', '', 'g'))))::DOUBLE / nullif(length(text) - length(regexp_replace(text, '\p{L}', '', 'g')), 0)"

ORACLES: dict[str, str] = {
    "tokenize_counts": f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_distinct FROM documents",
    "bm25_doc_stats": f"WITH {EN} SELECT n_docs, round(avg_len, 6) AS avg_len, round(mean_idf, 6) AS mean_idf FROM eone, emean",
    "bm25_idf_floor": f"WITH {EN} SELECT term, df, round(idf, 6) AS idf FROM eidf",
    "bm25_topk": f"WITH {EN}, {_score('e', QUERY)} SELECT doc_id, round(score, 6) AS score FROM en WHERE score > 0 ORDER BY en.score DESC, doc_id LIMIT 50",
    "bm25_bilingual_best": f"""WITH {EN}, {_score('e', QUERY)}, {OT}, {_score('x', OTHER)},
best AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM en UNION ALL SELECT * FROM xn) GROUP BY doc_id HAVING max(score) > 0)
SELECT doc_id, round(score, 6) AS score FROM best ORDER BY best.score DESC, doc_id LIMIT 50""",
    "bm25_query_batch": f"""WITH {_index('a', '')}, q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM q JOIN aidf USING (term) JOIN apost USING (term) JOIN adocs USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "dense_topk_cosine": f"WITH {VEC}, {FIRST}, s AS (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM v, f ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, round(s, 6) AS score FROM s",
    "dense_topk_l2": f"WITH {VEC}, {FIRST}, s AS (SELECT vec_id, 1 / (1 + list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS s FROM v, f ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, round(s, 6) AS score FROM s",
    "dense_topk_batch": f"""WITH {VEC}, parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL),
m AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS q FROM parts GROUP BY label),
s AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS score FROM v, m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "query_vector_mean": f"WITH {VEC}, {MEAN} SELECT (i - 1)::BIGINT AS i, round(x, 6) AS x FROM parts",
    "topic_search_docs": f"WITH {VEC}, {TOPIC} SELECT doc_id, round(score, 6) AS score FROM topics",
    "hybrid_fusion": f"WITH {FUSED} SELECT id, doc_id, round(chunk_score, 6) AS chunk_score, round(bm25_score, 6) AS bm25_score, round(topic_score, 6) AS topic_score, round(score, 6) AS score FROM fused",
    "expand_context": f"""WITH {EDGES}, c AS (SELECT doc_id, '[Document: ' || 'Document ' || doc_id || ' | Issuer: ' || source || ' | ? | ' || lang || ']' || chr(10) || '[Topics: ' || topic || ']' || chr(10) || chr(10) || text AS context FROM documents JOIN edges USING (doc_id))
SELECT doc_id, md5(context) AS context_md5, length(context) AS context_length FROM c""",
    "retrieval_metrics": """WITH r AS (SELECT lang, quality > 0 AS good, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id))
SELECT lang, round(coalesce(1.0::DOUBLE / min(rank) FILTER (good), 0), 6) AS mrr, round((count(*) FILTER (good AND rank <= 5))::DOUBLE / 5, 6) AS precision,
  round(coalesce((count(*) FILTER (good AND rank <= 5))::DOUBLE / nullif(count(*) FILTER (good), 0), 0), 6) AS recall, count(*) AS candidates, count(*) FILTER (good) AS relevant FROM r GROUP BY lang""",
    "similar_pairs": f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "topic_components": f"WITH RECURSIVE {PAIRS}, {COMPONENTS} SELECT topic, root FROM comp",
    "topic_canonical": f"WITH RECURSIVE {CLUSTERS} SELECT DISTINCT root, canonical FROM canon",
    "topic_contract": f"WITH RECURSIVE {CLUSTERS} SELECT DISTINCT doc_id, coalesce(canonical, edges.topic) AS topic FROM edges LEFT JOIN canon ON canon.topic = edges.topic",
    "topics_left": f"WITH RECURSIVE {CLUSTERS} SELECT vec_id AS topic FROM embeddings WHERE vec_id NOT IN (SELECT topic FROM canon WHERE topic <> canonical)",
    "merge_report": f"""WITH RECURSIVE {CLUSTERS}, n AS (SELECT (SELECT count(*) FROM embeddings) AS before, (SELECT count(*) FROM canon WHERE topic <> canonical) AS removed)
SELECT before, before - removed AS after, removed, round(CASE WHEN before > 0 THEN removed::DOUBLE / before * 100 ELSE 0 END, 6) AS percent FROM n""",
    "detach_delete": f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, topic FROM edges WHERE topic NOT IN (SELECT topic FROM canon WHERE topic <> canonical)",
    "graph_stats": "SELECT 'document' AS label, count(*) AS n FROM documents UNION ALL SELECT 'topic', count(*) FROM embeddings UNION ALL SELECT 'has_topic', count(*) FROM documents",
    "topic_edge_counts": f"WITH {EDGES} SELECT vec_id AS topic, count(doc_id) AS edges FROM embeddings LEFT JOIN edges ON topic = vec_id GROUP BY vec_id",
    "most_linked_topics": f"WITH {EDGES} SELECT vec_id AS topic, count(doc_id) AS edges FROM embeddings LEFT JOIN edges ON topic = vec_id GROUP BY vec_id ORDER BY 2 DESC, 1 LIMIT 10",
    "topics_by_label": "SELECT label, array_to_string(list(vec_id ORDER BY vec_id)[1:20], ',') AS topics, count(*) AS n FROM embeddings GROUP BY label",
    "community_counts": "SELECT count(DISTINCT label) AS communities FROM embeddings",
    "belongs_to": """SELECT 'document' AS kind, doc_id::VARCHAR AS key, (doc_id % 10)::INTEGER AS community FROM documents WHERE (doc_id % 10) IN (SELECT label FROM embeddings)
UNION ALL SELECT 'topic', vec_id::VARCHAR, label FROM embeddings WHERE label IS NOT NULL""",
    "unchunked_docs": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "untopiced_docs": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id LIMIT 100",
    "ingest_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY user_id",
    "ingest_edges_stubs": "SELECT id FROM (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem) WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)",
    "ingest_edges": "SELECT o_custkey AS src, o_orderpriority AS dst, arg_max(o_orderstatus, o_orderkey) AS type, max(o_orderkey) AS seq FROM orders GROUP BY ALL",
    "events_json": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, (props->>'$.k')::INTEGER AS k FROM events) GROUP BY event_type",
    "event_envelopes": "SELECT doc_id::VARCHAR AS id, source AS issuer, md5(text) AS content_md5 FROM documents",
    "keep_known_vectors": """WITH k AS (SELECT vec_id, CASE WHEN label < 5 AND embedding[2] IS NOT NULL THEN embedding[2:] || embedding[1:1] ELSE embedding END AS v FROM embeddings)
SELECT vec_id, (generate_subscripts(v, 1) - 1)::BIGINT AS i, round(unnest(v)::DOUBLE, 6) AS x FROM k""",
    "link_topics": f"WITH {EDGES} SELECT DISTINCT doc_id, topic FROM edges WHERE doc_id IN (SELECT doc_id FROM labels) AND topic IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "duplicate_keys": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "status_classification": """WITH r AS (SELECT source, n_chars AS size, coalesce(max(text) FILTER (lang = 'en'), '') AS en, coalesce(max(text) FILTER (lang = 'fr'), '') AS ar FROM documents GROUP BY ALL)
SELECT source, size, CASE WHEN en = '' AND ar = '' THEN 'EMPTY_CONTENT' WHEN ar = '' THEN 'ONLY_ENGLISH' WHEN en = '' THEN 'ONLY_ARABIC' ELSE 'SUCCESS_CONTENT' END AS status,
  CASE WHEN ar <> '' THEN 'html' WHEN en <> '' THEN 'pdf' END AS origin FROM r""",
    "lang_stats": "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other, count(*) FILTER (text IS NULL OR trim(text) = '') AS skipped, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source",
    "letter_shares": f"SELECT doc_id, round({LATIN}, 6) AS latin, coalesce({ARABIC} < 0.15, false) AS garbled_ar, coalesce({LATIN} < 0.15, false) AS garbled_en FROM documents",
    "page_titles": "SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS title FROM pages",
    "page_links": """WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: replace(x, '&amp;', '&')) AS links FROM pages)
SELECT page_id, len(links)::BIGINT AS n, array_to_string(links, ' ') AS links FROM l""",
    "blocked_pages": f"SELECT page_id, {_any('lower(html)', T.BLOCK_PHRASES)} AS blocked, {_any('html', T.NOISE_PHRASES)} AS noise FROM pages",
    "url_ids": f"SELECT page_id, {LAST} AS id, split_part(rtrim(url_decode(url), '/'), '/', -1) AS slug, regexp_matches(url, '/p/(19|20)\\d{{2}}/[\\p{{L}}\\p{{N}}_-]+/') AND NOT contains(url, '#') AS is_document FROM pages",
    "url_normalised": f"SELECT page_id, {CANON} AS canonical, {CANON} AS first, {CANON} || 'page/3/' AS third FROM pages",
    "category_labels": f"SELECT DISTINCT source, {LABEL} AS label, coalesce({_map(LABEL, T.LABEL_KEYS)}, lower(replace({LABEL}, ' ', '_'))) AS key FROM documents",
    "enqueue_new": f"WITH {CRAWL} SELECT url, arg_min(category, seq) AS category, min(seq) AS seq FROM rows_ WHERE url NOT IN (SELECT url FROM visited) AND url NOT IN (SELECT url FROM pending) GROUP BY url",
    "safe_restart_page": f"""WITH {CRAWL}, l AS (SELECT category, seq // 3 AS page, bool_and(contains(url, '?') OR contains(url, '#')) AS safe FROM rows_ GROUP BY ALL)
SELECT category, coalesce(max(page) FILTER (safe) + 1, 1)::BIGINT AS page FROM l GROUP BY category""",
    "requeue_failed": f"WITH {CRAWL}, f AS (SELECT DISTINCT {LAST} AS id FROM visited) SELECT url, category, id FROM (SELECT url, category, {LAST} AS id FROM rows_) JOIN f USING (id)",
    "crawl_status": f"""WITH {CRAWL} SELECT 'visited' AS state, count(*) AS n FROM visited UNION ALL SELECT 'pending', count(*) FROM pending
UNION ALL SELECT 'done', count(*) FROM rows_ WHERE category = 'com' UNION ALL SELECT 'failed', count(*) FROM rows_ WHERE category = 'net'""",
    "finish_urls": f"WITH {CRAWL} SELECT seq, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM pending) WHERE n > 1 OR category <> 'com'",
    "category_progress": f"WITH {CRAWL} SELECT category, arg_max(url, seq) AS url, max(seq) AS seq FROM rows_ GROUP BY category",
    "category_state": f"WITH {CRAWL} SELECT category, coalesce((SELECT max(seq) FROM visited WHERE visited.category = r.category), 0) AS page FROM (SELECT DISTINCT category FROM rows_) r",
    "community_prompt": """WITH t AS (SELECT source AS community, lpad(doc_id::VARCHAR, 12, '0') AS topic, lpad(doc_id::VARCHAR, 12, '0') || ' ' || source AS title FROM documents),
g AS (SELECT community, list(topic ORDER BY topic) AS topics, list(title ORDER BY title) AS titles FROM t GROUP BY community)
SELECT community, 'Topics: ' || array_to_string(topics[1:20], ', ') || chr(10) || chr(10) || 'Document titles:' || chr(10) || array_to_string(list_transform(titles[1:10], lambda x: '- ' || x), chr(10)) AS prompt FROM g""",
    "answer_prompt": f"""WITH {EN}, {_score('e', QUERY)}, b AS (SELECT doc_id, score FROM en WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10),
r AS (SELECT row_number() OVER (ORDER BY b.score DESC, doc_id) AS rank, text FROM b JOIN documents USING (doc_id))
SELECT 'Question: the and tion of the oure' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || string_agg('Excerpt ' || rank || ':' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS prompt FROM r""",
    "display_candidates": f"""WITH {FUSED}, r AS (SELECT id, fused.doc_id, round(score, 6) AS score, text FROM fused JOIN documents USING (doc_id))
SELECT row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank, round(score, 4) AS score, doc_id, substr(text, 1, 150) || '...' AS excerpt FROM r""",
    "greedy_merge": f"""WITH RECURSIVE {PAIRS}, ids AS (SELECT a, row_number() OVER (ORDER BY a) AS n FROM (SELECT DISTINCT a FROM pairs)),
near AS (SELECT n, a, (SELECT list(b ORDER BY b) FROM pairs WHERE pairs.a = ids.a) AS bs FROM ids),
step(n, gone, a, taken) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT near.n, list_concat(step.gone, CASE WHEN list_contains(step.gone, near.a) THEN [] ELSE list_filter(bs, lambda b: NOT list_contains(step.gone, b)) END), near.a,
    CASE WHEN list_contains(step.gone, near.a) THEN [] ELSE list_filter(bs, lambda b: NOT list_contains(step.gone, b)) END FROM step JOIN near ON near.n = step.n + 1)
SELECT unnest(taken) AS absorbed, a AS keeper FROM step""",
    "louvain_communities": f"WITH {EDGES} SELECT doc_id AS node, -topic - 1 AS community FROM edges UNION ALL SELECT DISTINCT -topic - 1, -topic - 1 FROM edges",
    "offline_topics": f"""WITH w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE length(term) > 3 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(((SELECT count(*) FROM documents) + 1) / df), 9) DESC, term) AS r FROM w JOIN df USING (term) QUALIFY r <= 7)
SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS topics FROM r GROUP BY doc_id""",
    "reranked": f"""WITH {FUSED}, c AS (SELECT id, fused.doc_id, '[Document: ' || 'Document ' || doc_id || ' | Issuer: ' || source || ' | ? | ' || lang || ']' || chr(10) || '[Topics: ' || topic || ']' || chr(10) || chr(10) || text AS text
  FROM fused JOIN documents USING (doc_id) JOIN edges USING (doc_id)),
o AS (SELECT id, doc_id, len(list_filter(list_distinct([{QUERY}]), lambda w: list_contains({TOKENS}[1:512], w)))::DOUBLE / len(list_distinct([{QUERY}])) AS s FROM c)
SELECT id, doc_id, round(s, 6) AS rerank_score FROM o ORDER BY s DESC, id LIMIT 5""",
    "score_stats": f"WITH {VEC}, {FIRST}, s AS (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM v, f ORDER BY s DESC, vec_id LIMIT 50) SELECT round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM s",
}
