"""The jobs on copies that grow, run twice and more, and against their SQL."""

import json
import logging

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import catalogue_pages, common, index_documents
from jobs.queries import ORACLES, QUERIES
from quillgraph.functions import text as T
from quillgraph.operators import bm25

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    found, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(map(tuple, found.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_postings(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    each = docs.select("lang", "doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("lang", "doc_id", "term").count()
    return sorted(map(tuple, each.collect()), key=repr)


def stood(spark, output):
    return sorted(map(tuple, index_documents.postings(spark, output).collect()), key=repr)


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    """Two runs over a folder that grows, one over the same, and documents sent again:
    changed, emptied, and in another language."""
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    send = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"batch": F.lit("own"), "term": F.lit(1)}).coalesce(1).write.mode("append").parquet(docs)
    first = [(1, "One two two", "en"), (2, "drei vier", "de"), (3, "cinq", None), (4, "", "en"), (5, None, "en"), (None, "lost", "en"), (6, "away", "en")]
    send(first)
    caplog.set_level(logging.INFO, logger="jobs")
    assert index_documents.run(spark, docs, out, mark) == {"batches": 1, "rows": 7}
    assert "read 7 rows, 1 without an id; wrote 6 documents, 6 postings" in caplog.text
    now = {r[0]: r for r in first if r[0] is not None}
    assert stood(spark, out) == plain_postings(spark, list(now.values()))
    held = files(tmp_path / "out")

    assert index_documents.run(spark, docs, out, mark) == {"batches": 0, "rows": 0}
    assert files(tmp_path / "out") == held

    second = [(1, "one changed", "en"), (2, "now english", "en"), (6, " ", "en"), (7, "new", "fr")]
    send(second)
    assert index_documents.run(spark, docs, out, mark) == {"batches": 1, "rows": 4}
    now |= {r[0]: r for r in second}
    assert stood(spark, out) == plain_postings(spark, list(now.values()))
    assert all(files(tmp_path / "out")[p] == t for p, t in held.items())  # the first batch's files are as they were


def test_index_of_one_pass_is_that_of_many(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i in range(3):
        docs.where(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    assert index_documents.run(spark, str(tmp_path / "docs"), str(tmp_path / "a"), str(tmp_path / "ma"), {"max_files": 1}) == {"batches": 3, "rows": docs.count()}
    assert index_documents.run(spark, str(tmp_path / "docs"), str(tmp_path / "b"), str(tmp_path / "mb"))["batches"] == 1
    assert stood(spark, str(tmp_path / "a")) == stood(spark, str(tmp_path / "b"))
    words = spark.createDataFrame([("the",), ("of",), ("the",)], "term string")
    scores = lambda index: [(r.doc_id, round(r.score, 9)) for r in bm25.search([(index, words)], 20).collect()]
    plain = bm25.build(docs.where("lang = 'en'"), T.tokens(F.col("text")))
    assert scores(index_documents.index(spark, str(tmp_path / "a"), "en")) == scores(plain)


def test_a_batch_that_is_run_again_leaves_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "en"), (1, "a c", "en"), (2, "d", "fr")], "doc_id long, text string, lang string").withColumns({"written_at": F.current_timestamp(), "file": F.lit("f")})
    for _ in range(2):
        index_documents.write_batch(rows, 4, str(tmp_path / "out"), index_documents.DEFAULTS)
        assert stood(spark, str(tmp_path / "out")) == [("en", 1, "a", 1), ("en", 1, "c", 1), ("fr", 2, "d", 1)]


def page(title, links=0, more=""):
    return f"<html><article><h1>{title}</h1>{more}" + "".join(f'<a href="/{i}">x</a>' for i in range(links)) + "</article></html>"


def test_catalogue(spark, tmp_path):
    rows = [(1, "http://A.com/x", page("Old")), (2, "http://A.com/x/?q=1#t", page(" New ", 2)), (3, "https://b.org/y", page("", 1)), (4, "nowhere", None), (5, None, page("No url")), (6, "http://a.com/z", page("Z", 1, T.BLOCK_PHRASES[0]))]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"canonical": F.lit(1), "tld": F.lit("own")}).write.parquet(str(tmp_path / "pages"))
    want = [("http://A.com/x/", 2, "a.com", "x", "New", 2, "page", "com"), ("http://a.com/z/", 6, "a.com", "z", "Z", 1, "blocked", "com"), ("https://b.org/y/", 3, "b.org", "y", None, 1, "empty", "org"), ("nowhere/", 4, "", "nowhere", None, 0, "empty", "none")]
    for _ in range(2):
        assert catalogue_pages.run(spark, str(tmp_path / "pages"), str(tmp_path / "out")) == {"read": 6, "without_url": 1, "pages": 4, "sites": 3}
        found = spark.read.schema(catalogue_pages.CATALOGUE).parquet(str(tmp_path / "out/pages"))
        assert sorted(map(tuple, found.collect())) == want
        sites = spark.read.parquet(str(tmp_path / "out/sites")).select("host", "pages", "blocked", "empty", "links", "tld")
        assert sorted(map(tuple, sites.collect())) == [("", 1, 0, 1, 0, "none"), ("a.com", 2, 1, 0, 3, "com"), ("b.org", 1, 0, 1, 1, "org")]


def test_nothing_to_read(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    none.write.parquet(str(tmp_path / "pages"))
    assert catalogue_pages.run(spark, str(tmp_path / "pages"), str(tmp_path / "out")) == {"read": 0, "without_url": 0, "pages": 0, "sites": 0}
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    assert index_documents.run(spark, str(tmp_path / "docs"), str(tmp_path / "i"), str(tmp_path / "m"))["rows"] == 0


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"max_files": 3}))
    assert common.configured(spark, str(tmp_path / "c.json"), index_documents.DEFAULTS) == index_documents.DEFAULTS | {"max_files": 3}
    assert common.configured(spark, None, {"a": 1}) == {"a": 1}
    (tmp_path / "c.json").write_text('{"max_file": 3}')
    with pytest.raises(ValueError, match="max_file"):
        common.configured(spark, str(tmp_path / "c.json"), index_documents.DEFAULTS)
    for job in (index_documents, catalogue_pages):
        shipped = f"{common.__file__.rsplit('/', 1)[0]}/{job.__name__.rsplit('.', 1)[-1]}.json"
        assert common.configured(spark, shipped, job.DEFAULTS) == job.DEFAULTS
