"""Block-max search against the whole index."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import bm25
from quillgraph.operators.bm25_blocks import BlockIndex, windows


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 10, 30, 80])))) for i in range(3000)]
    rows += [(5000 + i, "rare " + "w0 " * (i % 7)) for i in range(9)] + [(6000, ""), (6001, None), (6002, "w1 same"), (6003, "w1 same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return bm25.build(docs, F.filter(F.split(F.coalesce("text", F.lit("")), " +"), lambda t: t != ""))


def best(rows):
    return [(r.doc_id, round(r.score, 9)) for r in rows.collect()]


@pytest.mark.parametrize("words", [["rare"], ["w0", "w1"], ["rare", "w0", "w0", "w5"], ["w59", "w58", "w57"], ["same", "absent"], ["w2", None]])
def test_search_is_that_of_all_postings(spark, index, tmp_path, words):
    BlockIndex.save(index, str(tmp_path / "b"), window_docs=40)
    blocks = BlockIndex.load(spark, str(tmp_path / "b"))
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    for k in (1, 10, 5000):
        found = blocks.search(terms, k, probe=3)
        want = bm25.score(index, terms.where("term is not null")).orderBy(F.desc("score"), "doc_id").limit(k)
        assert best(found.rows) == best(want)
    assert blocks.search(terms, 0).rows.count() == 0


def test_most_windows_are_skipped(spark, index, tmp_path):
    BlockIndex.save(index, str(tmp_path / "b"), window_docs=40)
    blocks = BlockIndex.load(spark, str(tmp_path / "b"))
    for words, share in ((["w20"], 0.5), (["rare", "w0"], 0.5), (["w20", "w30"], 1)):
        found = blocks.search(spark.createDataFrame([(w,) for w in words], "term string"), 10, probe=3)
        assert found.windows > 40 and found.read <= share * found.windows
    headers = blocks.blocks.where("term = 'w20'").groupBy("win").agg(F.sum("bound"))._jdf.queryExecution().executedPlan().toString()
    assert "docs" not in headers.split("ReadSchema")[1]


def test_windows_are_even(spark):
    """A third of all documents has one length."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("len"))
    sizes = [r["count"] for r in windows(docs, 100).groupBy("win").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 200


def test_an_index_of_nothing(spark, index, tmp_path):
    none = bm25.build(spark.createDataFrame([], "doc_id long, text string"), F.split("text", " "))
    BlockIndex.save(none, str(tmp_path / "b"))
    assert BlockIndex.load(spark, str(tmp_path / "b")).search(spark.createDataFrame([("a",)], "term string"), 5).rows.count() == 0
