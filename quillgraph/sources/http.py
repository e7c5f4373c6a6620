"""Fetching pages and PDF files.

``fetch`` takes a table of urls, of any size, and asks each host at a set rate. For a short
list there are Python data sources, whose ``urls`` is a text file on the driver, a url a
line:

    spark.dataSource.register(PageSource)
    spark.read.format("fetched_pages").option("urls", path).load()

What can't be fetched is a row with an error, so one bad url fails no job.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions import text as T


class Blocked(Exception):
    """The site answered with a page that isn't the one asked for."""


def get(url: str, timeout: float) -> tuple[bytes, str]:
    """(body, content type); redirects are followed."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0", "Accept-Language": "ar,en;q=0.8"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read(), answer.headers.get("Content-Type") or ""


def with_retries(fetch, retries: int, least: float, most: float, sleep=time.sleep):
    """What ``fetch`` gives, tried again after waits that double from ``least`` to
    ``most`` seconds; the last error if all tries fail."""
    for turn in range(retries):
        try:
            return fetch()
        except (OSError, Blocked):  # http errors, time-outs and refused connections are OSErrors
            if turn + 1 == retries:
                raise
            sleep(min(most, least * 2**turn))


class Rate:
    """Token buckets by key (a host, a model): ``rate`` tokens a second come in, at most
    ``burst`` are kept, and ``take`` waits for one."""

    def __init__(self, rate: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held: dict[str, tuple[float, float]] = {}  # tokens, as of when

    def take(self, key: str) -> None:
        now = self.clock()
        tokens, since = self.held.get(key, (float(self.burst), now))
        tokens = min(float(self.burst), tokens + (now - since) * self.rate)
        if tokens < 1:
            wait = (1 - tokens) / self.rate
            self.sleep(wait)
            now, tokens = max(self.clock(), now + wait), 1.0
        self.held[key] = tokens - 1, now


def by_turn(rows: DataFrame, host: Column, tasks: int) -> DataFrame:
    """Rows dealt by host to ``tasks`` tasks, where the hosts take turns, so that a task
    seldom waits for one while others could be asked. A host is in one task: politeness
    makes its requests a sequence anyway. Nothing is gathered: turns are a sort."""
    dealt = rows.withColumn("host", host).repartition(tasks, "host")
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    return dealt.withColumn("turn", turn).sortWithinPartitions("turn", "host").drop("turn")


def fetch(urls: DataFrame, pdf: bool = False, rate: float = 0.5, burst: int = 1, tasks: int | None = None, retries: int = 5, least_wait: float = 2, most_wait: float = 60, timeout: float = 30) -> DataFrame:
    """url, html (or content), error: a row for each distinct url of a table.

    A host gets at most ``rate`` requests a second (and ``burst`` at once), tries again
    included, from any number of tasks (by default twice the cores). Null and blank urls
    are left out. Speculative tasks would ask twice; leave speculation off.
    """
    tasks = tasks or 2 * urls.sparkSession.sparkContext.defaultParallelism
    url = F.trim("url")
    rows = by_turn(urls.select(url.alias("url")).where(F.length("url") > 0).distinct(), F.lower(F.regexp_extract("url", r"^[^:/?#]*://([^/?#:]*)", 1)), tasks)
    kind = pa.binary() if pdf else pa.string()

    def run(batches):
        limits = Rate(rate, burst)
        for batch in batches:
            for address, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):

                def once(address=address, host=host):
                    limits.take(host)
                    return body_of(address, timeout, pdf)

                try:
                    body, error = with_retries(once, retries, least_wait, most_wait), None
                except (OSError, ValueError, Blocked) as e:
                    body, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([body], kind), pa.array([error], pa.string())], names=["url", "body", "error"])

    found = rows.select("url", "host").mapInArrow(run, f"url string, body {'binary' if pdf else 'string'}, error string")
    return found.withColumnRenamed("body", "content" if pdf else "html")


def body_of(url: str, timeout: float, pdf: bool):
    """The page's text, or the file's bytes if it is a PDF by its type or first bytes."""
    body, kind = get(url, timeout)
    if pdf:
        return body if "pdf" in kind.lower() or body.startswith(b"%PDF") else None
    html = body.decode("utf-8", "replace")
    if any(p in html.lower() for p in T.BLOCK_PHRASES):
        raise Blocked("block page")
    return html


@dataclass
class Urls(InputPartition):
    urls: list[str]


class Fetcher(DataSourceReader):
    def __init__(self, options: dict, pdf: bool):
        self.path = options["urls"]
        self.parts = int(options.get("partitions", 8))
        self.retries = int(options.get("retries", 5))
        self.waits = float(options.get("least_wait", 2)), float(options.get("most_wait", 60))
        self.timeout = float(options.get("timeout", 60 if pdf else 30))
        self.delay = float(options.get("delay", 1))
        self.pdf = pdf

    def partitions(self) -> list[InputPartition]:
        with open(self.path, encoding="utf-8") as f:
            urls = [u for line in f if (u := line.strip())]
        return [Urls(urls[i :: self.parts]) for i in range(min(self.parts, len(urls)))]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                yield url, with_retries(lambda url=url: body_of(url, self.timeout, self.pdf), self.retries, *self.waits), None
            except (OSError, ValueError, Blocked) as e:
                yield url, None, f"{type(e).__name__}: {e}"
            time.sleep(random.uniform(self.delay, 3 * self.delay))


class PageSource(DataSource):
    """url, html, error."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return Fetcher(self.options, False)


class PdfSource(DataSource):
    """url, content, error: no content for what is no PDF by its type or first bytes."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pdfs"

    def schema(self) -> str:
        return "url string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return Fetcher(self.options, True)
