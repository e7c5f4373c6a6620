"""Feeds that workers follow, discovery by state, constraints at write."""

import pytest
from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.operators import upsert
from quillgraph.plans.worker_queries import as_nodes
from quillgraph.sources import sinks
from quillgraph.streaming import discovery, feeds, workers


def embed(c):
    return providers.embedding(c, providers.HashEmbedder(8))


def send(spark, queue, rows):
    """(id, contentAr, contentEn, seq) as node events."""
    sinks.push_events(upsert.node_event(as_nodes(spark.createDataFrame(rows, "id string, contentAr string, contentEn string, seq long"))), queue)


def test_workers_read_only_what_is_new(spark, tmp_path):
    """As many rows as came, however many there are; the chunks are those of the polling
    worker over the same documents."""
    root, queue, polled = (str(tmp_path / x) for x in ("a", "queue", "b"))
    tables = workers.Tables(spark, root, 4)

    def step():
        workers.ingest(spark, queue, root).awaitTermination()
        q, t = feeds.chunk_stream(spark, root, embed=embed), feeds.topic_stream(spark, root, tables, providers.offline_topics, embed)
        q.awaitTermination()
        t.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress), sum(p["numInputRows"] for p in t.recentProgress)

    send(spark, queue, [(f"d{i}", None, f"text of number {i} " * (i % 3 + 1), i) for i in range(200)] + [("later", None, " ", 300), ("both", "نص", "text", 301)])
    assert step() == (201, 201)
    held = {p: p.stat().st_mtime_ns for p in (tmp_path / "a/feed").rglob("*.parquet")}
    send(spark, queue, [("d7", None, "another text", 400), ("later", None, "text at last", 401), ("new", None, "wholly new", 402), ("gone", None, None, 403)])
    assert step() == (2, 2)
    assert step() == (0, 0)
    assert all(p.stat().st_mtime_ns == t for p, t in held.items())  # nothing old is written again

    found = feeds.held(spark, root, "chunks", feeds.CHUNKS, ["id"])
    plain = workers.Tables(spark, polled, 4)
    texts = [(f"d{i}", None, f"text of number {i} " * (i % 3 + 1), i) for i in range(200)] + [("both", "نص", "text", 301), ("later", None, "text at last", 401), ("new", None, "wholly new", 402)]
    plain.write("documents", 0, as_nodes(spark.createDataFrame(texts, "id string, contentAr string, contentEn string, seq long")), ["id"], workers.latest(["id"]))
    workers.follow(lambda: workers.chunk_poll(plain, 1000), 0, once=True)
    pick = lambda df: sorted(tuple(r) for r in df.select("id", "doc_id", "language", "index", "text").collect())
    assert pick(found) == pick(plain.read("chunks"))
    links = feeds.held(spark, root, "has_topic", feeds.LINKS, ["doc_id", "name"])
    assert links.select("doc_id").distinct().count() == 203
    assert links.join(tables.read("topics"), "name", "left_anti").count() == 0
    assert tables.read("topics").where("size(embedding) = 8").count() == links.select("name").distinct().count()


def test_a_batch_that_is_run_again(spark, tmp_path):
    root = str(tmp_path / "a")
    tables = workers.Tables(spark, root, 4)
    batch = upsert.node_event(as_nodes(spark.createDataFrame([("x", None, "one", 1), ("y", None, None, 2)], "id string, contentAr string, contentEn string, seq long")))
    for _ in range(2):
        workers.apply_events(tables, batch, 0)
        feeds.chunk_stream(spark, root).awaitTermination()
    found = feeds.held(spark, root, "chunks", feeds.CHUNKS, ["id"]).collect()
    assert [(r.doc_id, r.text) for r in found] == [("x", "one")]


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in discovery.SETTINGS}
    for k, v in discovery.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_discovery_goes_on_after_a_stop(spark, tmp_path, rocks):
    """Pages in any order and many runs, one of them stopped between batches, end as one
    pass over all pages."""
    pages = [("a", 1, ["u1", "u2"]), ("a", 2, ["u3"]), ("a", 3, []), ("a", 4, ["beyond"]), ("b", 1, ["v1"]), ("b", 2, ["v2", None, ""]), ("c", 1, None), ("d", 2, ["waits"]), ("e", 1, ["e1"])]
    came = [[pages[1], pages[4]], [pages[3], pages[0]], [pages[6], pages[7], (None, 1, ["x"])], [pages[2], pages[0], pages[5]], [pages[8]]]
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run(**options):
        stream = spark.readStream.schema(discovery.LISTING).options(**options).json(folder)
        return discovery.discovered(stream).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)

    for i, some in enumerate(came):
        spark.createDataFrame(some, discovery.LISTING).coalesce(1).write.mode("append").json(folder)
        if i in (1, 4):
            run(maxFilesPerTrigger=1).awaitTermination()
    rows = [tuple(r) for r in spark.read.parquet(out).collect()]
    want = [("a", 1, "u1"), ("a", 1, "u2"), ("a", 2, "u3"), ("b", 1, "v1"), ("b", 2, "v2"), ("e", 1, "e1")]
    assert sorted(r[:3] for r in rows if r[2] is not None) == want
    assert sorted(r[:2] for r in rows if r[3] == "DISCOVERY_DONE") == [("a", 3), ("c", 1)]


def test_constraints_hold_when_a_version_is_published(spark, tmp_path):
    tables = workers.Tables(spark, str(tmp_path / "a"), 4)
    rows = [("a", "old", 1), ("a", "new", 2), ("b", "x", 1), (None, "lost", 5), (None, "lost", 6)]
    df = lambda r: spark.createDataFrame(r, "id string, v string, seq long")
    assert tables.publish("things", 0, df(rows), ["id"]) == {"rows": 5, "without_key": 2, "published": 2, "duplicates": 1}
    assert sorted(tuple(r) for r in tables.read("things").select("id", "v").collect()) == [("a", "new"), ("b", "x")]
    assert sorted(tuple(r) for r in tables.read("things_violations").select("key", "reason", "rows").collect()) == [('{"id":"a"}', "duplicate", 2), ("{}", "no key", 2)]
    assert tables.publish("things", 1, df([("b", "y", 3)]), ["id"]) == {"rows": 1, "without_key": 0, "published": 1, "duplicates": 0}
    assert sorted(tuple(r) for r in tables.read("things").select("id", "v").collect()) == [("a", "new"), ("b", "y")]
    assert tables.read("things").groupBy("id").agg(F.count("v").alias("n")).where("n > 1").count() == 0


def graph_of(spark, root):
    tables = workers.Tables(spark, root, 4)
    return [sorted(map(repr, map(tuple, tables.read(name).select(*columns).collect()))) for name, columns in (("documents", ("id", "contentEn", "seq")), ("relations", ("src", "dst", "type")), ("quarantine", ("json",)))]


@pytest.mark.parametrize("fails_after", ["documents"])
def test_the_graph_is_the_same_after_a_stop_in_a_batch(spark, tmp_path, monkeypatch, fails_after):
    """The ingestor dies in its second batch, after some of its tables are written."""
    queue = str(tmp_path / "queue")
    for i in range(3):
        send(spark, queue, [(f"d{j}", None, f"text {i} of {j}", 100 * i + j) for j in range(i, i + 6)])
        edges = spark.createDataFrame([(None, f"d{i}", f"x{i}", "AMENDS" if i else None, i)], "id string, source_id string, target_id string, relation_type string, seq long")
        sinks.push_events(upsert.edge_event(edges), queue)
    spark.createDataFrame([(1, "{bad")], "seq long, json string").write.mode("append").json(queue)
    workers.ingest(spark, queue, str(tmp_path / "whole"), max_files=2).awaitTermination()

    plain, written = workers.Tables.write, []

    def dying(self, name, version, *more):
        plain(self, name, version, *more)
        written.append((name, version))
        if (name, version) == (fails_after, 1) and written.count((name, version)) == 1:
            raise OSError("lost")

    monkeypatch.setattr(workers.Tables, "write", dying)
    with pytest.raises(Exception, match="lost"):
        workers.ingest(spark, queue, str(tmp_path / "stopped"), max_files=2).awaitTermination()
    workers.ingest(spark, queue, str(tmp_path / "stopped"), max_files=2).awaitTermination()
    assert written.count((fails_after, 1)) == 2 and max(v for _, v in written) > 1
    assert graph_of(spark, str(tmp_path / "stopped")) == graph_of(spark, str(tmp_path / "whole"))


def test_old_versions_go(spark, tmp_path):
    tables = workers.Tables(spark, str(tmp_path / "a"), 2, keep=2)
    for v in range(7):
        tables.write("t", v, spark.createDataFrame([("k", v, v)], "id string, v long, seq long"), ["id"], workers.latest(["id"]))
    assert [(r.id, r.v) for r in tables.read("t").collect()] == [("k", 6)]
    assert tables.versions("t") == [4, 5, 6] and len([p for p in (tmp_path / "a/t").iterdir() if p.name.startswith("v=")]) == 3
