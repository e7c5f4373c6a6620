"""Discovery of urls as a stateful stream: listing pages in, urls and progress out.

Listing pages of many categories arrive as they are fetched, in any order and in any
number of runs. State is held by category: the page that comes next, whether an empty
page was reached, and pages that came too early, which wait. A page is read when all
before it have been, so that a stream that is stopped and started again goes on where
the crawl was, and ends as one pass over all pages does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LISTING = "category string, page long, urls array<string>"
FOUND = "category string, page long, url string, state string"
SEPARATOR = "\n"  # no url has one

#: What the stream needs of its session.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Discovery(StatefulProcessor):
    """Rows (category, page, urls) of one category: its pages in order up to the first
    empty one. A page that was read already, or lies beyond the end, changes nothing."""

    def __init__(self, first: int = 1):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "next long, done boolean")
        self.waiting = handle.getMapState("waiting", "page long", "urls string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, done = self.progress.get() if self.progress.exists() else (self.first, False)
        for part in rows:
            for page, urls in zip(part["page"], part["urls"]):
                if not done and page >= at and not self.waiting.containsKey((int(page),)):
                    self.waiting.updateValue((int(page),), (SEPARATOR.join(urls),))
        found = []
        while not done and self.waiting.containsKey((at,)):
            urls = self.waiting.getValue((at,))[0]
            self.waiting.removeKey((at,))
            if urls:
                found += [(key[0], at, url, "DISCOVERING") for url in urls.split(SEPARATOR)]
                at += 1
            else:
                done = True
                found.append((key[0], at, None, "DISCOVERY_DONE"))
        if done:
            self.waiting.clear()
        self.progress.update((at, done))
        yield pd.DataFrame(found, columns=["category", "page", "url", "state"]).astype({"page": "int64"})

    def close(self) -> None:
        pass


def discovered(listing: DataFrame, first: int = 1) -> DataFrame:
    """category, page, url, state of a stream of listing pages (``LISTING``): a row a
    url, and one without url for a category whose end is reached."""
    rows = listing.where("category is not null and page is not null").select("category", "page", F.coalesce(F.filter("urls", lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>")).alias("urls"))
    return rows.groupBy("category").transformWithStateInPandas(Discovery(first), FOUND, "Append", "None")
