"""Fetching a table of urls at a rate by host."""

import http.server
import threading
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.sources.http import Rate, by_turn, fetch


@pytest.fixture
def site():
    seen = defaultdict(list)

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen[self.headers["Host"].split(":")[0]].append((time.monotonic(), self.path))
            tried = sum(p == self.path for _, p in seen[self.headers["Host"].split(":")[0]])
            code = 404 if "missing" in self.path else 503 if "flaky" in self.path and tried < 3 else 200
            body = T.BLOCK_PHRASES[0] if "block" in self.path else "%PDF-1 x" if "pdf" in self.path else f"<p>{self.path}</p>"
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1], seen
    server.shutdown()


@pytest.mark.parametrize("tasks", [1, 3, 7])
def test_no_host_is_asked_faster_than_its_rate(spark, site, tasks):
    port, seen = site
    urls = [(f"http://{host}:{port}/{i}",) for host in ("127.0.0.1", "localhost") for i in range(12)]
    found = fetch(spark.createDataFrame([*urls, *urls, (None,), (" ",)], "url string").repartition(5), rate=20, burst=2, tasks=tasks).collect()
    assert Counter((r.url, r.html, r.error) for r in found) == Counter((u, f"<p>/{u.rsplit('/', 1)[1]}</p>", None) for (u,) in urls)
    for asked in seen.values():
        times = sorted(t for t, _ in asked)
        assert len(times) == 12
        assert all(times[i + k] - times[i] >= (k - 2) / 20 - 0.04 for k in range(3, 12) for i in range(12 - k))


def test_errors_retries_and_files(spark, site):
    port, seen = site
    paths = ["flaky", "missing", "block", "fine"]
    urls = spark.createDataFrame([(f"http://127.0.0.1:{port}/{p}",) for p in paths] + [("nonsense",), ("http://127.0.0.1:1/closed",)], "url string")
    found = {r.url.rsplit("/", 1)[-1]: (r.html, r.error) for r in fetch(urls, rate=200, retries=3, least_wait=0.01, most_wait=0.02, tasks=2).collect()}
    assert found["flaky"] == ("<p>/flaky</p>", None) and found["fine"] == ("<p>/fine</p>", None)
    assert "404" in found["missing"][1] and "Blocked" in found["block"][1] and "ValueError" in found["nonsense"][1] and found["closed"][1]
    assert Counter(p for _, p in seen["127.0.0.1"]) == {"/flaky": 3, "/missing": 3, "/block": 3, "/fine": 1}
    files = fetch(spark.createDataFrame([(f"http://127.0.0.1:{port}/{p}",) for p in ("pdf", "fine")], "url string"), pdf=True, rate=200).collect()
    assert {r.url.rsplit("/", 1)[-1]: r.content for r in files} == {"pdf": bytearray(b"%PDF-1 x"), "fine": None}
    assert fetch(urls.where("false")).count() == 0


def test_hosts_take_turns(spark):
    rows = spark.createDataFrame([(f"http://{h}/{i}",) for h, n in (("a", 5), ("b", 2), ("c", 3)) for i in range(n)], "url string")
    found = [r.host for r in by_turn(rows, F.regexp_extract("url", "//([^/]*)", 1), 1).collect()]
    assert "".join(found) == "abcabcacaa"


def test_tokens():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    rate = Rate(2, burst=3, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        rate.take("a")
    rate.take("b")
    assert slept == [0.5, 0.5]
    now[0] += 100
    for _ in range(4):
        rate.take("a")
    assert slept == [0.5] * 3
