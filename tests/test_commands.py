"""Commands from listing pages to a hybrid search, the fetching sources, and tables."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillgraph import cli
from quillgraph.functions import text as T
from quillgraph.operators import chunk, graph, retrieval, vector
from quillgraph.sources import inputs
from quillgraph.sources.http import Blocked, PageSource, PdfSource, with_retries
from quillgraph.streaming.workers import Tables, latest


class Site(http.server.BaseHTTPRequestHandler):
    asked: dict[str, int] = {}

    def do_GET(self):
        n = Site.asked[self.path] = Site.asked.get(self.path, 0) + 1
        if self.path == "/gone" or (self.path == "/flaky" and n < 3):
            self.send_error(503)
            return
        body = {"/flaky": b"<h1>late</h1>", "/blocked": b"Just a moment...", "/file": b"%PDF-1.4 x"}.get(self.path, b"<h1>page</h1>")
        self.send_response(200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_fetching(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "urls").write_text("".join(f"{at}/{x}\n" for x in ("a", "flaky", "gone", "blocked", "file")))
    options = {"urls": str(tmp_path / "urls"), "retries": 3, "least_wait": 0.01, "delay": 0}
    for source in (PageSource, PdfSource):
        spark.dataSource.register(source)
    found = {r.url.rsplit("/")[-1]: r for r in spark.read.format("fetched_pages").options(**options).load().collect()}
    assert found["a"].html == "<h1>page</h1>" and found["flaky"].html == "<h1>late</h1>"
    assert "503" in found["gone"].error and found["blocked"].error.startswith("Blocked") and found["gone"].html is None
    assert Site.asked["/gone"] == 3 and Site.asked["/blocked"] == 3
    files = {r.url.rsplit("/")[-1]: r.content for r in spark.read.format("fetched_pdfs").options(**options).load().collect()}
    assert bytes(files["file"]).startswith(b"%PDF") and files["a"] is None
    server.shutdown()


def test_waits_double_up_to_a_bound():
    waits = []

    def fail():
        raise Blocked("x")

    with pytest.raises(Blocked):
        with_retries(fail, 5, 2, 10, waits.append)
    assert waits == [2, 4, 8, 10]


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    assert [r.path.rsplit("/")[-1] for r in inputs.pdf_files(spark, str(tmp_path)).collect()] == ["a.pdf"]


def test_commands(spark, tmp_path):
    root = str(tmp_path / "root")
    run = lambda *arguments: cli.main([arguments[0], "--root", root, *arguments[1:]], spark)
    link = lambda i: f'<h2><a href="https://s/p/2020/doc-{i}/">x</a></h2>'
    listing = [{"category": "c", "page": 1, "html": link(1) + link(2)}, {"category": "c", "page": 2, "html": link(2) + link(3)}, {"category": "c", "page": 3, "html": ""}]
    (tmp_path / "listings.json").write_text("\n".join(map(json.dumps, listing)))
    assert dict(run("crawler", "--listings", str(tmp_path / "listings.json"))) == {"PENDING": 3}
    page = lambda i, words: {"url": f"https://s/p/2020/doc-{i}/", "html": f'<article><h1>Title {i}</h1><div class="entry-content"><p>{words}</p></div></article>'}
    pages = [page(1, "taxes and customs duties on imported goods"), page(2, "fishing licences for coastal waters")]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)))
    assert dict(run("crawler", "--pages", str(tmp_path / "pages.json"))) == {"PENDING": 1, "DONE": 2}
    assert run("ingestor", "--once")[0]["count"] == 2
    assert run("schema") == []
    assert dict(run("chunker", "--once"))["ar"] == 2
    assert {"customs", "fishing"} <= {r.name for r in run("topics", "--once", "--batch-size", "10")}
    assert run("merge", "--dry-run") == [] == run("merge")
    assert len(run("communities")) == 2
    assert list(run("index")[0]) == [0, 2]
    best = run("search", "--query", "fishing in waters", "--top-k", "1")
    assert best[0].doc_id == "doc-2" and "Title 2" in best[0].excerpt
    found = run("hybrid", "--query", "customs duties", "--final-n", "1")
    assert found[0].doc_id == "doc-1"
    assert dict(run("crawler", "--reset")) == {}


def test_tables_rewrite_what_they_touch_and_vacuum(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 4)
    rows = lambda *r: spark.createDataFrame(r, "id string, x int, seq long")
    tables.write("t", 0, rows(*((str(i), i, 0) for i in range(40))), ["id"], latest(["id"]))
    for n in (1, 2, 3):
        tables.write("t", n, rows(("7", 100 + n, n)), ["id"], latest(["id"]))
    tables.write("t", 3, rows(("7", 103, 3)), ["id"], latest(["id"]))  # the same batch again
    want = {str(i): 103 if i == 7 else i for i in range(40)}
    assert {r.id: r.x for r in tables.read("t").collect()} == want
    assert len([p for p in (tmp_path / "t" / "v=1").iterdir() if p.name.startswith("bucket=")]) == 1
    tables.vacuum("t", 1)
    assert not (tmp_path / "t" / "v=1").exists() and (tmp_path / "t" / "v=0").exists()
    assert {r.id: r.x for r in tables.read("t").collect()} == want and tables.versions("t") == [3]


def test_chunks_of_a_document_that_fails(spark):
    def length(text):
        if "bad" in text:
            raise ValueError("no tokens")
        return len(text.split())

    docs = spark.createDataFrame([("a", None, "one two three"), ("b", None, "bad text"), ("c", "  ", "")], "doc_id string, contentAr string, contentEn string")
    found = chunk.chunks(docs, 2, 0, length=length, keep_problems=True).collect()
    assert {(r.doc_id, r.text, r.problem) for r in found} == {("a", "one two", None), ("a", "three", None), ("b", None, "ValueError: no tokens")}


def test_louvain_against_a_plain_one(spark):
    """Cliques in a ring: the communities of greatest modularity are known."""
    links = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(6) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 6) + 1) for c in range(6)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "x long, y long, w double")
    placed = graph.louvain(edges)
    assert {r.node: r.community for r in placed.collect()} == {10 * c + i: 10 * c for c in range(6) for i in range(6)}
    assert graph.modularity(edges, placed) > 0.75


def test_prompt_of_nothing_and_one_query_only(spark):
    groups = spark.createDataFrame([(1, [], []), (2, ["t"], ["", "b"])], "community int, topics array<string>, titles array<string>")
    found = {r.community: r.prompt for r in retrieval.community_prompt(groups).collect()}
    assert found == {1: "Topics: —\n\nDocument titles:\n—", 2: "Topics: t\n\nDocument titles:\n- b"}
    rows = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    two = spark.createDataFrame([([1.0],), ([2.0],)], "query_vec array<double>")
    with pytest.raises(Exception, match="more than one query"):
        vector.nearest(rows, two, 1).collect()
    assert vector.nearest(rows, two.limit(0), 1).count() == 0


def test_body_that_renders_empty_is_html(spark):
    rows = spark.createDataFrame([("https://s/p/2020/a/", "c", '<article><div class="entry-content"><p><a class="pdf-link" href="x.pdf">x</a></p><p><img src="i.png"></p></div></article>')], "url string, category string, html string")
    docs, _ = inputs.records(rows)
    assert docs.select("ar_source").first()[0] == "html"
    assert spark.range(1).select(T.content_source(F.lit(False), F.lit("u"))).first()[0] == "pdf"


def test_similar_pairs_skip_what_is_out_of_reach(spark):
    """Clustered vectors in small blocks, against all pairs; few blocks meet."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    v = np.vstack([c + rng.normal(size=(25, 16)) * 0.4 for c in centres] + [np.zeros((1, 16)), centres[:1], centres[:1]])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "vec_id long, embedding array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True) if i < j}
    for pivots in (1, 24):
        found = vector.similar_pairs(rows, 0.9, block=8, pivots=pivots).collect()
        assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    assert vector.similar_pairs(rows.where("vec_id = 9999"), 0.9).count() == 0


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The splitter once more, by places in the text: pieces of the coarsest separator
    that occurs, gathered while they fit; what is too long alone is split by finer ones."""
    n = chunk.token_length
    kind = next(s for s in separators if s in text)
    finer = separators[separators.index(kind) + 1 :]
    pieces = [p for p in (text.split(kind) if kind else text) if p]
    out, i = [], 0
    while i < len(pieces):
        if n(pieces[i]) > size and finer:
            out += plain_split(pieces[i], size, overlap, finer)
            i += 1
            continue
        # a run of pieces of ordinary length, cut into chunks that share up to ``overlap``
        j = i
        while j < len(pieces) and not (n(pieces[j]) > size and finer):
            j += 1
        start = end = i
        while end < j:
            while end < j and (start == end or sum(map(n, pieces[start : end + 1])) <= size):
                end += 1
            whole = kind.join(pieces[start:end]).strip()
            if whole:
                out.append(whole)
            if end < j:
                while start < end and (sum(map(n, pieces[start:end])) > overlap or sum(map(n, pieces[start : end + 1])) > size):
                    start += 1
        i = j
    return out


def test_splitter_against_a_plain_one():
    import random

    rng = random.Random(9)
    for _ in range(300):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 120))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", ". ", "  "]) for w in words)
        size, overlap = rng.randint(2, 20), rng.randint(0, 5)
        assert chunk.split(text, size, min(overlap, size)) == plain_split(text, size, min(overlap, size)), repr((text, size, overlap))
