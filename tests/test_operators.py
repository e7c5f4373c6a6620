"""Semantics that the tables can't show, on hand-made rows."""

import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.functions import html as H
from quillgraph.functions import text as T
from quillgraph.operators import bm25, chunk, crawl, graph, retrieval, upsert, vector
from quillgraph.plans.worker_queries import as_nodes
from quillgraph.sources import inputs
from quillgraph.streaming.workers import Tables, catch_up, chunk_new, chunk_poll, ingest, latest


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_tokenizers(spark):
    r = one(spark, T.tokens(F.lit("Ça_va, x2 ½!")), T.arabic_tokens(F.lit("مُحَمَّد ١٢، abc")))
    assert r[0] == ["ça_va", "x2", "½"] and r[1] == ["مُحَمَّد", "١٢،"]


def test_urls(spark):
    r = one(spark, T.last_segment(F.lit("https://h/p/2020/x//")), T.slug(F.lit("https://h/a%20b+c/")), T.is_document_url(F.lit("https://h/p/2020/ab-c/")), T.is_document_url(F.lit("https://h/p/2020/ab-c/#more")), T.canonical_url(F.lit("h/x//")), T.listing_url(F.lit("h"), F.lit(2)))
    assert list(r) == ["x", "a b+c", True, False, "h/x/", "h/page/2/"]


def test_arabic_date_and_labels(spark):
    r = one(spark, T.arabic_date(F.lit("5 مارس 2020")), T.arabic_date(F.lit("5 foo 2020")), T.arabic_date(F.lit("x مارس 2020")), T.category_key(T.category_label(F.lit("مرسوم-سلطاني"))), T.category_key(T.category_label(F.lit("New-Kind"))))
    assert list(r) == ["2020-03-05", None, None, "royal_decree", "new_kind"]


def test_garbled_and_blank(spark):
    r = one(spark, T.is_garbled(F.lit("abc"), F.lit("AR")), T.is_garbled(F.lit("123"), F.lit("AR")), T.is_garbled(F.lit("مرسوم"), F.lit("AR")), T.has_text(F.lit(" \n　")), T.has_text(F.lit(None).cast("string")))
    assert list(r) == [True, False, False, False, False]


def test_markdown_cleanup(spark):
    r = one(spark, T.clean_markdown(F.lit("a  \n\n\n\n---\nb\n")), T.promote_headings(F.lit("### a\n#### b\n###### c")), T.promote_headings(F.lit("## a\n### b")))
    assert list(r) == ["a\n\nb", "## a\n### b\n###### c", "## a\n### b"]


def test_topic_list_and_header(spark):
    r = one(spark, T.topic_list(F.lit('[" a ", 3, "", "b"]')), T.context_header(F.lit(None).cast("string"), F.lit("i"), F.lit("d"), F.lit("k"), F.array().cast("array<string>")))
    assert r[0] == ["a", "b"] and r[1] == "[Document: ? | Issuer: i | d | k]\n[Topics: —]\n\n"


PAGE = """<html><body><nav><h1>no</h1></nav><article><header><h1> The <b>title</b></h1></header><ul><li class="post-date"><span class="meta-text">5 مارس 2020</span></li></ul>
<div class="post-inner"><div class="entry-content"><p><a class="pdf-link" href="/a.pdf">pdf</a><a class="decree-link" href="/en/a">en</a></p>
<h3>One</h3><p>Text<br>more</p><ul><li>x</li><li>y</li></ul><p>تم التصديق بموجب</p><p>gone</p></div></div>
<div class="post-tags"><a rel="tag">مكتب</a><a rel="tag">وزارة العدل</a></div></article></body></html>"""
AMENDED = """<article><div class="entry-content"><figure class="wp-block-table"><table><tr><td><a href="/p/2001/old/">a</a></td><td><a href="/p/2002/new/">b</a></td></tr></table></figure></div></article>"""


def test_page_to_record(spark):
    pages = spark.createDataFrame([("https://h/p/2020/d1/", "مرسوم سلطاني", PAGE), ("https://h/p/2021/d2/", "قانون معدل", AMENDED), ("https://h/p/2021/d3/", "قانون معدل", "<p>plain"), ("https://h/p/2021/d4/", None, None)], "url string, category string, html string")
    docs, edges = inputs.records(pages)
    found = {r.id: r for r in docs.collect()}
    d = found["d1"]
    assert (d.title, d.date, d.issuer, d.url_en, d.pdf_url_ar, d.ar_source, d.status) == ("Thetitle", "2020-03-05", "وزارة العدل", "/en/a", "/a.pdf", "html", "ONLY_ARABIC")
    assert "## One" in d.contentAr and "- x" in d.contentAr and "gone" not in d.contentAr
    assert found["d3"].status == "EMPTY_CONTENT" and "d4" in found
    assert [tuple(r) for r in edges.collect()] == [("d2", "old", "new", "AMENDS")]


def test_listing_and_sitemap(spark):
    html = '<h2><a href="h/p/2020/a/">A</a></h2><h2><a href="h/p/2020/a">A</a></h2><h2><a href="h/p/1800/b/">B</a></h2><a href="h/p/2020/c/">no</a>'
    found = inputs.listing(spark.createDataFrame([("k", 1, html), ("k", 2, "")], "category string, page int, html string")).collect()
    assert [tuple(r) for r in found] == [("k", 1, 0, "h/p/2020/a/")]
    xml = '<u xmlns="http://x"><url><loc>h/c/uncategorized/</loc></url><url><loc>h/c/%D8%AA%D8%B9%D9%85%D9%8A%D9%85/</loc></url></u>'
    assert [r.key for r in inputs.sitemap(spark.createDataFrame([(xml,)], "xml string")).collect()] == ["circular"]


def test_pdf_blocks(spark):
    rows = [("a", "EN", 0, 0, 0, "Article 1 x"), ("a", "EN", 0, 1, 0, "body"), ("b", "EN", 0, 0, 1, None), ("c", "EN", 0, 0, 0, "  "), ("d", "AR", 0, 0, 0, "latin only")]
    found = {r.doc_id: (r.markdown, r.problem) for r in inputs.pdf_markdown(spark.createDataFrame(rows, "doc_id string, lang string, page int, ord int, kind int, text string")).collect()}
    assert found == {"a": ("## Article 1 x\n\nbody", None), "b": (None, "image"), "c": (None, "empty"), "d": (None, "encoding")}


def test_splitter():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(10))
    found = chunk.split(text, 50, 10)
    assert all(chunk.token_length(c) <= 50 for c in found) and found[0].startswith("w0_0") and found[-1].endswith("w9_29")
    assert set(" ".join(found).split()) == set(text.split())
    assert chunk.split("", 10, 2) == [] and chunk.split("a" * 5, 2, 0, len) == ["aa", "aa", "a"]


def test_upserts(spark):
    doc = lambda i, **more: json.dumps({"type": "node", "payload": {"id": i, **more}})
    raw = spark.createDataFrame([(1, doc("a", title="t")), (2, doc("a")), (3, '{"type":"edge","payload":{"source_id":"a","target_id":"z"}}'), (4, "nonsense"), (5, '{"type":"other","payload":{}}'), (6, '{"type":"edge","payload":{"source_id":"a","target_id":"z","relation_type":"AMENDS"}}')], "seq long, json string")
    nodes, edges, bad = upsert.read_events(raw)
    merged = upsert.merge(None, nodes, ["id"])
    assert [(r.id, r.title) for r in merged.collect()] == [("a", None)]
    relations = upsert.merge(None, edges, ["src", "dst"])
    assert [(r.src, r.dst, r.type) for r in relations.collect()] == [("a", "z", "AMENDS")]
    assert [r.id for r in upsert.stubs(merged, relations).collect()] == ["z"]
    assert sorted(r.seq for r in bad.collect()) == [4, 5]
    assert upsert.merge(merged, nodes, ["id"]).count() == 1


def test_graph(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    degrees = spark.createDataFrame([(1, 1), (2, 4), (3, 4), (5, 0), (6, 0)], "topic long, edges long")
    clusters = graph.merge_clusters(pairs, degrees)
    assert {(r.topic, r.canonical) for r in clusters.collect()} == {(1, 2), (2, 2), (3, 2), (5, 5), (6, 5)}
    edges = spark.createDataFrame([(9, 1), (9, 2), (8, 7)], "doc_id long, topic long")
    assert {tuple(r) for r in graph.contract(edges, clusters).collect()} == {(9, 2), (8, 7)}
    assert {tuple(r) for r in graph.greedy_merge(pairs).collect()} == {(2, 1), (6, 5)}
    assert graph.components(pairs.limit(0).select(F.col("a").alias("x"), F.col("b").alias("y"))).count() == 0


def test_louvain(spark):
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame(clique(range(4)) + clique(range(10, 14)) + [(0, 10, 1.0)], "x long, y long, w double")
    placed = graph.louvain(edges, levels=2, rounds=4)
    groups = {}
    for r in placed.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [10, 11, 12, 13]]
    assert graph.modularity(edges, placed) > 0.3


def test_louvain_settles(spark):
    """Every leaf of a star is in its topic's community, and of a pair as well."""
    edges = spark.range(2000).select(F.col("id").alias("x"), (-F.pmod("id", F.lit(20)) - 1).alias("y"), F.lit(1.0).alias("w"))
    pairs = spark.range(3000, 3200, 2).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"), F.lit(1.0).alias("w"))
    placed = {r.node: r.community for r in graph.louvain(edges.union(pairs)).collect()}
    assert all(placed[i] == placed[-(i % 20) - 1] for i in range(2000))
    assert all(placed[i] == placed[i + 1] for i in range(3000, 3200, 2))
    assert len(set(placed.values())) == 120
    ring = spark.range(30).select(F.col("id").alias("x"), F.pmod(F.col("id") + 1, F.lit(30)).alias("y"), F.lit(1.0).alias("w"))
    with pytest.raises(RuntimeError):
        graph.louvain(ring, rounds=0)



def test_crawl(spark):
    found = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "a", 3), ("u3", "a", 4)], "url string, category string, seq long")
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert [tuple(r) for r in crawl.enqueue(found, urls("u2"), urls("u3")).collect()] == [("u1", "a", 1)]
    listing = spark.createDataFrame([("c", 1, "u1"), ("c", 2, "u2"), ("c", 2, "u4"), ("e", 1, "u9")], "category string, page long, url string")
    progress = spark.createDataFrame([("c", 2), ("e", 3), ("n", 5)], "category string, page long")
    assert {tuple(r) for r in crawl.safe_restart_page(listing, progress, urls("u1", "u2")).collect()} == {("c", 2), ("e", 1), ("n", 1)}
    assert crawl.discovered(spark.createDataFrame([("c", 1, 3), ("c", 2, 0), ("d", 1, 2)], "url string, page long, n_urls long")).where("state = 'DISCOVERY_DONE'").count() == 1


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.0)], "rank long, rerank_score double")
    assert [round(x, 3) for x in list(retrieval.metrics(rows, 2).head())[:3]] == [0.5, 0.5, 1.0]
    assert list(retrieval.metrics(rows, 0).head())[1] == 0.0
    assert list(retrieval.metrics(rows.where("rank < 2"), 2).head())[:3] == [0.0, 0.0, 0.0]
    dense = spark.createDataFrame([("x", 1, 0.0), ("y", 2, 0.0)], "id string, doc_id long, score double")
    none = spark.createDataFrame([], "doc_id long, score double")
    assert [(r.id, r.score) for r in retrieval.fuse(dense, none, none, 5).collect()] == [("x", 0.0), ("y", 0.0)]
    other = spark.createDataFrame([(3, 1.0)], "doc_id long, score double")
    assert retrieval.fuse(dense, other, none, 5, mode="union").count() == 3


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.1])], "vec_id long, embedding array<float>")
    query = spark.createDataFrame([([1.0, 0.0],)], "query_vec array<double>")
    assert [r.vec_id for r in vector.nearest(rows, query, 2).collect()] == [1, 4]
    assert [(r.a, r.b) for r in vector.similar_pairs(rows, 0.9).collect()] == [(1, 4)]


@pytest.mark.parametrize("rounds", [1])
def test_streaming_ingest_and_chunks(spark, tmp_path, rounds):
    queue, root = str(tmp_path / "queue"), str(tmp_path / "tables")
    send = lambda rows: spark.createDataFrame(rows, inputs.EVENTS).write.mode("append").json(queue)
    send([(1, json.dumps({"type": "node", "payload": {"id": "a", "contentEn": "one two"}})), (2, "bad")])
    ingest(spark, queue, root).awaitTermination(120)
    send([(3, json.dumps({"type": "node", "payload": {"id": "a", "contentEn": "three"}})), (4, json.dumps({"type": "node", "payload": {"id": "b", "contentEn": " "}}))])
    ingest(spark, queue, root).awaitTermination(120)
    tables = Tables(spark, root)
    assert {r.id: r.contentEn for r in tables.read("documents").collect()} == {"a": "three", "b": " "}
    assert [r.id for r in chunk_new(tables, 0).collect()] == ["a-en-0"]
    assert chunk_new(tables, 1).count() == 1


def test_parse_page_of_nothing(spark):
    assert spark.range(1).select(H.parse_page(F.lit(None).cast("string"))["title"].alias("t")).head().t == ""


def test_greedy_merge_waits_for_earlier_keepers(spark):
    """2 goes to 1 in the first round, in which 4 keeps; 3 keeps for want of 2, and as the
    earlier one has 5."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 5), (4, 5)], "a long, b long")
    assert {tuple(r) for r in graph.greedy_merge(pairs).collect()} == {(2, 1), (5, 3)}


def test_greedy_merge_is_that_of_one_row_at_a_time(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(220)})
    keeper = {}
    for a in range(120):
        if a not in keeper:
            keeper |= {y: a for x, y in pairs if x == a and y not in keeper}
    found = graph.greedy_merge(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == set(keeper.items())


def test_scores_equal_to_nine_decimals_are_a_tie(spark):
    """Document 9 has one query term more than the others, of a weight of 1e-11."""
    listed = spark.createDataFrame([(9, ["a", "b"]), (4, ["a", "c"]), (5, ["a", "c"])], "doc_id long, tokens array<string>")
    totals = spark.createDataFrame([(10**6, 2.0)], "n_docs long, avg_len double")
    n = 500_000 - 2.5e-6  # as many documents as give an idf of some 1e-11
    terms = spark.createDataFrame([("a", 3.0), ("b", n), ("c", 3.0)], "term string, df double")
    asked = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, term string")
    found = bm25.search_many(bm25.Index(terms, totals, listed=listed), asked, 3).orderBy("rank").collect()
    assert max(found, key=lambda r: r.score).doc_id == 9 and [r.doc_id for r in found] == [4, 5, 9]


def test_unterminated_references_stay(spark):
    pages = {"R&amp;D&amp": "R&D&amp", "a&copy;b &copy c&#38;d&#38": "a©b &copy c&d&", "x&ampy; &nosuch; & z": "x&ampy; &nosuch; & z"}
    rows = spark.createDataFrame([(f"<h1>{html}</h1>",) for html in pages], "html string")
    assert [r.t for r in rows.select(H.parse_page(F.col("html"))["title"].alias("t")).collect()] == list(pages.values())


def test_catching_up_takes_polls_that_grow(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 2)
    docs = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("text").alias("contentEn"), F.lit(0).cast("long").alias("seq"))
    tables.write("documents", 0, as_nodes(docs), ["id"], latest(["id"]))
    sizes = []

    def poll(share):
        sizes.append(chunk_poll(tables, None, share=share))
        return sizes[-1]

    assert catch_up(tables, "polled", "doc_id", poll, 30) == 1000 == sum(sizes)
    assert len(sizes) < 9 and sizes[0] < 80
    assert tables.read("chunks").select("doc_id").distinct().count() == 1000
    assert catch_up(tables, "polled", "doc_id", poll, 30) == 0


def test_words_are_counted_in_their_row(spark):
    """No shuffle makes postings, and a stored index reads its texts no more."""
    docs = spark.createDataFrame([(1, "b a b ½"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    listed = docs.select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    index = bm25.Index(None, None, listed=listed)
    assert sorted(tuple(r) for r in index.postings.collect()) == sorted([(1, "a", 1), (1, "b", 2), (1, "½", 1), (4, "c", 1)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(index.postings)
    counted = index.counted()
    assert sorted(tuple(r) for r in counted.docs.collect()) == [(1, 4), (4, 1)]
    assert sorted(map(tuple, counted.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    assert "regexp" not in plan(counted.docs) and "regexp" not in plan(counted.postings)


@pytest.mark.parametrize("common", [0, 2, 1 << 16])
def test_common_words_of_topics(spark, monkeypatch, common):
    monkeypatch.setattr(providers, "COMMON", common)
    docs = spark.createDataFrame([(1, "alpha alpha beta gamma"), (2, "alpha beta delta delta"), (3, "alpha the"), (4, "of"), (5, None)], "doc_id long, text string")
    found = {r.doc_id: r.topics for r in providers.offline_topics(docs, 2).collect()}
    assert found == {1: ["gamma", "alpha"], 2: ["delta", "beta"], 3: ["alpha"]}


def test_a_tile_of_pairs_holds_one_product():
    """Two tiles of 2,048 rows: the product (32 MB) and little else, and the same pairs."""
    v = np.random.default_rng(3).normal(size=(2048, 16))
    zero = pa.array([0] * 2048, pa.int64())
    cell = pa.table({"p": zero, "q": zero, "mine": zero, "id": pa.array(range(2048)), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    found = vector.pairs_of_blocks(0.8)(cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    norm = np.linalg.norm(v, axis=1)
    want = np.argwhere(np.triu((v @ v.T) / np.outer(norm, norm) >= 0.8, 1))
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [tuple(w) for w in want.tolist()] and len(want)
    assert peak < 60e6
