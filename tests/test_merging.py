"""Clusters that grow by batches, and the range search they rest on, against plain runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, vector
from quillgraph.operators.vector_index import VectorIndex
from quillgraph.streaming import merging

SCHEMA = "vec_id long, embedding array<double>"


def chain(n=60, step=0.2, dim=6):
    """Vectors on an arc, each near to the next ones only."""
    return [[float(np.cos(i * step)), float(np.sin(i * step))] + [0.0] * (dim - 2) for i in range(n)]


def planted(seed, n=240, around=30, dim=6, spread=0.25):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(around, dim))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    return [(middles[rng.integers(around)] + rng.normal(size=dim) * spread * rng.random()).tolist() for _ in range(n)]


def plain(rows, threshold):
    """The smallest id of each cluster of two and more, by search from every vector."""
    ids = sorted(rows)
    v = np.array([rows[i] for i in ids])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= threshold
    root = {}
    for start in range(len(ids)):
        if ids[start] in root or near[start].sum() < 2:
            continue
        open_, seen = [start], {start}
        while open_:
            for j in np.flatnonzero(near[open_.pop()]):
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        root |= {ids[j]: ids[start] for j in seen}
    return root


def held(clusters):
    rows = clusters.roots().collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.9), ("l2sq", 0.7), ("cosine", -1.0), ("cosine", 1.5)])
def test_range_search_is_that_of_a_scan(spark, tmp_path, metric, threshold):
    rows = list(enumerate(planted(4)))
    index = VectorIndex.build(spark.createDataFrame(rows + [(900, None), (901, [0.0] * 6)], SCHEMA), str(tmp_path / "i"), metric, cells=9)
    asked = spark.createDataFrame([(i, v) for i, v in rows[:25]] + [(50, None)], "query_id long, query_vec array<double>")
    found = index.within(asked, threshold, block=20).collect()
    y = np.array([v for _, v in rows])
    want = set()
    for i, v in rows[:25]:
        score = (y @ np.array(v)) / (np.linalg.norm(y, axis=1) * np.linalg.norm(v)) if metric == "cosine" else 1 / (1 + ((y - np.array(v)) ** 2).sum(1))
        want |= {(i, int(j)) for j in np.flatnonzero(score >= threshold)}
    if metric == "l2sq":  # the row of no length is at a distance of one
        want |= {(i, 901) for i, v in rows[:25] if 1 / (1 + float(np.dot(v, v))) >= threshold}
    assert {(r.query_id, r.id) for r in found} == want and len(found) == len(want)
    names = spark.createDataFrame([(i, i % 3 + 1000) for i, _ in rows if i % 2], "id long, name long")
    named = index.within(asked, threshold, names, block=20).collect()
    assert {(r.query_id, r.id) for r in named} == {(q, i % 3 + 1000 if i % 2 and i < 900 else i) for q, i in want}
    assert len(named) == len(set(named))


def test_range_search_reads_cells_in_reach(spark, tmp_path):
    """Of forty cells along an arc those around the query."""
    arc = list(enumerate(chain(400, 0.015)))
    index = VectorIndex.build(spark.createDataFrame(arc, SCHEMA), str(tmp_path / "i"), cells=40)
    found = index.within(spark.createDataFrame([(0, arc[200][1])], "query_id long, query_vec array<double>"), float(np.cos(0.05)), block=10)
    assert sorted(r.id for r in found.collect()) == list(range(197, 204))
    cell, n, least, most = index.ranges()
    away = np.arccos(np.clip(index.centres[cell] @ np.array(arc[200][1]) / np.linalg.norm(index.centres[cell], axis=1), -1, 1))
    assert ((away <= most + 0.05) & (away >= least - 0.05)).sum() <= 8


def test_batches_end_as_one_run(spark, tmp_path):
    rows = dict(enumerate(planted(1)))
    clusters, so_far = merging.Clusters(spark, str(tmp_path / "c"), 0.9), {}
    order = np.random.default_rng(1).permutation(len(rows)).tolist()
    for number, part in enumerate((order[:120], order[120:121], order[121:])):
        clusters.add(spark.createDataFrame([(i, rows[i]) for i in part], SCHEMA), number)
        so_far |= {i: rows[i] for i in part}
        assert held(clusters) == plain(so_far, 0.9)
    degrees = spark.createDataFrame([(i, i % 5) for i in rows], "topic long, edges long")
    pairs = vector.similar_pairs(spark.createDataFrame(list(rows.items()), SCHEMA), 0.9)
    order_of = lambda df: sorted(map(tuple, df.select("topic", "root", "canonical").collect()))
    assert order_of(clusters.chosen(degrees)) == order_of(graph.merge_clusters(pairs, degrees))


def test_one_topic_unites_many_clusters(spark, tmp_path):
    """A chain whose odd links come last: clusters of one become one; a batch that is run
    again, or comes with known ids, changes nothing."""
    arc = chain(15)
    clusters = merging.Clusters(spark, str(tmp_path / "c"), float(np.cos(0.21)))
    clusters.add(spark.createDataFrame([(i, arc[i]) for i in range(0, 15, 2)], SCHEMA), 0)
    assert held(clusters) == {}
    last = spark.createDataFrame([(i, arc[i]) for i in range(1, 15, 2)], SCHEMA)
    for _ in range(2):
        clusters.add(last, 1)
        assert held(clusters) == dict.fromkeys(range(15), 0)
    clusters.add(spark.createDataFrame([(3, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (40, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0])], SCHEMA), 2)  # 3 keeps its vector
    assert held(clusters) == dict.fromkeys(range(15), 0)


def test_first_batch_is_run_again(spark, tmp_path):
    clusters = merging.Clusters(spark, str(tmp_path / "c"), 0.9)
    rows = dict(enumerate(planted(7, 40)))
    for _ in range(2):
        clusters.add(spark.createDataFrame(list(rows.items()), SCHEMA), 0)
    clusters.add(spark.createDataFrame([(100, rows[0])], SCHEMA), 1)
    assert held(clusters) == plain(rows | {100: rows[0]}, 0.9)


def test_odd_rows_and_empty_batches(spark, tmp_path):
    """Unusable rows take no part; copies of one vector are one cluster; an id with
    several vectors in a batch keeps the smallest; other columns don't matter."""
    clusters = merging.Clusters(spark, str(tmp_path / "c"), 0.99)
    clusters.add(spark.createDataFrame([], SCHEMA), 0)
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [(5, one), (6, one), (7, one), (8, two), (9, two), (9, one), (None, two), (10, None), (11, [0.0, 0.0]), (12, [float("nan"), 1.0]), (13, [])]
    clusters.add(spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("own"), "batch": F.lit(1), "root": F.lit(2), "v": F.lit(3)}), 1)
    assert held(clusters) == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8}
    clusters.add(spark.createDataFrame([(10, one), (None, None)], SCHEMA), 2)  # it didn't count as known
    clusters.add(spark.createDataFrame([], SCHEMA), 3)
    assert held(clusters) == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 5}


def test_a_stream_of_topics(spark, tmp_path):
    """Two runs over a growing folder of topics."""
    rows = dict(enumerate(planted(3, 80)))
    clusters = merging.Clusters(spark, str(tmp_path / "c"), 0.9)
    for part in (range(50), range(50, 80)):
        spark.createDataFrame([(i, rows[i]) for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        merging.follow_topics(stream, clusters).awaitTermination()
        assert held(clusters) == plain({i: rows[i] for i in range(part[-1] + 1)}, 0.9)
