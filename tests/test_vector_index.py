"""The stored vector index against scans: planted clusters, odd rows, batches."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import vector
from quillgraph.operators.vector_index import VectorIndex


def clusters(seed=1, around=24, each=40, dim=16, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(around, dim)) * 3
    return [(i, (middles[i % around] + rng.normal(size=dim) * spread).tolist()) for i in range(around * each)]


@pytest.fixture(scope="module")
def table(spark):
    rows = clusters() + [(5000, None), (5001, [float("nan")] * 16), (5002, [0.0] * 16), (5003, [None] * 16), (5004, []), (5005, clusters()[3][1]), (5006, clusters()[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit("own"), "batch": F.lit("own"), "away": F.lit(1)}).repartition(3).persist()


def query(spark, v):
    return spark.createDataFrame([(v,)], "query_vec array<double>")


def pairs(rows):
    return [(r.id if "id" in r else r.vec_id, round(r.score, 9)) for r in rows.collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_search_is_that_of_a_scan_and_reads_few_cells(spark, table, tmp_path, metric):
    index = VectorIndex.build(table, str(tmp_path / "i"), metric, cells=24)
    good = table.where("vec_id < 5000 or vec_id > 5004" if metric == "cosine" else "vec_id not in (5000, 5001, 5003, 5004)")
    rng = np.random.default_rng(2)
    read = []
    for v in [clusters()[3][1], clusters()[7][1], rng.normal(size=16).tolist(), [1.0] + [0.0] * 15]:
        found = index.search(query(spark, v), 10)
        assert pairs(found.rows) == pairs(vector.nearest(good, query(spark, v), 10, metric))
        read.append(len(found.read) / found.cells)
    assert read[0] <= 0.2 and read[1] <= 0.2
    ids = [i for i, _ in pairs(index.search(query(spark, clusters()[3][1]), 3).rows)]
    assert ids == [3, 5005, 5006]  # ties to smaller ids
    assert pairs(index.search(query(spark, clusters()[3][1]), 2000).rows) == pairs(vector.nearest(good, query(spark, clusters()[3][1]), 2000, metric))
    assert len(index.search(query(spark, clusters()[3][1]), 10, most_cells=1).read) == 1
    assert index.search(query(spark, None), 10).rows.count() == 0
    with pytest.raises(ValueError, match="more than one"):
        index.search(query(spark, [1.0]).union(query(spark, [1.0])), 1)


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_search_of_many_queries(spark, table, tmp_path, metric):
    index = VectorIndex.build(table, str(tmp_path / "i"), metric, cells=12)
    rng = np.random.default_rng(5)
    asked = [(i, v) for i, v in clusters()[:30]] + [(100 + i, rng.normal(size=16).tolist()) for i in range(5)] + [(200, None), (201, [float("inf")] * 16)]
    found = index.search_many(spark.createDataFrame(asked, "query_id long, query_vec array<double>"), 7, block=50).collect()
    good = table.where("vec_id < 5000 or vec_id > 5004" if metric == "cosine" else "vec_id not in (5000, 5001, 5003, 5004)")
    want = {}
    held = [(r.vec_id, np.array(r.embedding)) for r in good.collect()]
    for q, v in asked[:35]:
        x = np.array(v)
        score = lambda y: x @ y / np.linalg.norm(x) / np.linalg.norm(y) if metric == "cosine" else 1 / (1 + ((x - y) ** 2).sum())  # noqa: B023, E731
        want[q] = sorted(((-round(score(y), 9), i) for i, y in held))[:7]
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.id))
    assert {q: sorted(x) for q, x in got.items()} == want


def test_batches_are_added_once(spark, table, tmp_path):
    index = VectorIndex.build(table.where("vec_id % 2 = 0"), str(tmp_path / "i"), cells=10)
    more = table.where("vec_id % 2 = 1")
    for _ in range(2):
        index.add(more, 1)
        assert index.rows().count() == len(clusters()) + 2
    v = query(spark, clusters()[9][1])
    again = VectorIndex(spark, str(tmp_path / "i"))
    assert pairs(again.search(v, 20).rows) == pairs(vector.nearest(table.where("vec_id < 5000 or vec_id > 5004"), v, 20))


def test_an_index_of_nothing(spark, table, tmp_path):
    index = VectorIndex.build(table.where("false"), str(tmp_path / "i"))
    assert index.search(query(spark, [1.0] * 16), 5).rows.count() == 0
    assert index.search_many(spark.createDataFrame([(1, [1.0] * 16)], "query_id long, query_vec array<double>"), 5).count() == 0
    with pytest.raises(ValueError, match="no cells"):
        index.add(table, 1)


def test_files_of_other_cells_stay_closed(spark, table, tmp_path):
    index = VectorIndex.build(table, str(tmp_path / "i"), cells=24)
    found = index.search(query(spark, clusters()[3][1]), 10)
    plan = index.rows().where(F.col("cell").isin(list(found.read)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#", plan) and len(found.read) <= 0.2 * found.cells
    rows = index.rows().where(F.col("cell").isin(list(found.read)))
    assert {r.f for r in rows.select(F.regexp_extract("_metadata.file_path", "cell=([0-9]+)", 1).alias("f")).distinct().collect()} == set(map(str, found.read))
