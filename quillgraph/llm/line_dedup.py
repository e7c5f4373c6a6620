"""Lines that many documents share, by levelled sorted runs of line hashes.

O'Neil et al., "The log-structured merge-tree" (1996). Documents come in batches. A
batch's distinct lines are counted, merge-anti-joined with the runs of lines that are
known to be common, and what is left is added as a sorted run of (hash, documents,
lines). When a level has ``fan`` runs they are merged into one run of the next level,
and lines that reach ``min_docs`` leave it for a run of common lines. So a hash is
rewritten once a level, and a common line costs later batches nothing.

Runs are bucketed and sorted tables: an anti-join with them shuffles only the new batch,
and a merge moves a run's rows once a level. A line is named by two 64-bit hashes of its key. Lines are counted in each task
before they are shuffled, and those with a thousandth and more of a batch's lines, at
most a thousand a batch, are put into the plan where documents are judged, so that no
join has a key with more lines than that. All of it is DataFrame functions.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, text_or_empty

#: ASCII white space, which is stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("h1", "h2")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(bare: Column) -> Column:
    """A-Z lower-cased; of a line of ASCII alone ``lower`` does just that."""
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(text: Column, min_chars: int) -> Column:
    """An array of (h1, h2, pos) of the lines whose keys are long enough."""
    keys = F.transform(F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(SPACE))), key_of)
    named = F.transform(keys, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), i.alias("pos"))))
    return F.array_compact(named)


class LineRuns:
    """The runs. ``counted[level]`` are runs of lines still to be counted, ``common``
    those of lines that ``min_docs`` documents have."""

    def __init__(self, spark: SparkSession, min_docs: int, fan: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.counted: list[list[str]] = [[]]
        self.common: list[str] = []

    def write(self, rows: DataFrame) -> str:
        """A sorted run. Rows dealt by hash over ``buckets`` give a file a bucket."""
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, name: str) -> DataFrame:
        """A run as plain files. Unions read runs so: one of bucketed tables claims their
        partitioning in this Spark, but may read them in other partitions, and an
        aggregation above it, which then goes without a shuffle, is wrong."""
        return self.spark.read.schema("h1 long, h2 long, docs long, lines long").parquet(f"{self.root}/{name}")

    def merged(self, names: list[str]) -> DataFrame:
        """The runs' rows by hash, summed."""
        every = functools.reduce(lambda a, b: a.unionByName(b), [self.read(n) for n in names])
        return every.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.sum("lines").alias("lines"))

    def add(self, batch: DataFrame) -> None:
        """One batch: h1, h2, docs, lines, a row a distinct line."""
        for run in self.common:
            batch = batch.join(self.spark.table(run).hint("merge"), list(HASH), "left_anti")
        self.counted[0].append(self.write(batch.select(*HASH, "docs", "lines")))
        level = 0
        while len(self.counted[level]) >= self.fan:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """The runs of a level as one of the next, without lines that are common now."""
        old = self.counted[level]
        whole = self.write(self.merged(old))
        every = self.read(whole)
        self.counted[level] = []
        if level + 1 == len(self.counted):
            self.counted.append([])
        self.counted[level + 1].append(self.write(every.where(F.col("docs") < self.min_docs)))
        self.common.append(self.write(every.where(F.col("docs") >= self.min_docs)))
        self.drop([*old, whole])
        if len(self.common) >= self.fan:
            old = self.common
            self.common = [self.write(self.merged(old))]
            self.drop(old)

    def all_common(self) -> DataFrame:
        """h1, h2 of all lines that are common now, as a run."""
        runs = [n for level in self.counted for n in level]
        parts = [self.merged(runs).where(F.col("docs") >= self.min_docs)] if runs else []
        parts += [self.read(n) for n in self.common]
        found = functools.reduce(lambda a, b: a.unionByName(b), [p.select(*HASH) for p in parts])
        return self.spark.table(self.write(found.distinct()))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 8, fan: int = 4, heavy: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text: a row a document, without the lines that
    ``min_docs`` documents and more have (keys of ``min_chars`` code points and more).

    A null or empty text is one empty line. A row is a document: equal rows count
    each. A line that a document has twice counts once, and both go. Null ids are
    allowed; an empty table gives no rows; other columns are ignored. Documents are
    dealt by hash into ``batches`` batches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), text_or_empty(text_col).cast("string").alias("text"))
    # a row's name: rows of one id and text share it, and are judged alike
    rows = rows.withColumns({"own_1": F.xxhash64("own_id", "text"), "own_2": F.xxhash64(F.lit(7), "own_id", "text")})
    by_place = rows.select("own_1", F.sort_array(hashes(F.col("text"), min_chars)).alias("s"))
    batch = F.pmod("own_1", F.lit(batches)).cast("int").alias("batch")
    before = lambda i: F.get("s", i - 1)
    first = lambda x, i: F.coalesce((before(i)["h1"] != x["h1"]) | (before(i)["h2"] != x["h2"]), F.lit(True)).cast("int")
    each = F.transform("s", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), first(x, i).alias("first")))
    lines = cut(by_place.select(batch, F.explode_outer(each).alias("x")).where("x is not null").groupBy("batch", "x.h1", "x.h2").agg(F.sum("x.first").alias("docs"), F.count(F.lit(1)).alias("lines")), "batch")

    runs, often = LineRuns(spark, min_docs, fan), []
    total = {r.batch: r.n for r in lines.groupBy("batch").agg(F.sum("lines").alias("n")).collect()}  # a row a batch
    for b in sorted(total):
        own = lines.where(F.col("batch") == b)
        often += own.where(F.col("lines") * heavy >= total[b]).select("h1").collect()  # at most ``heavy``
        runs.add(own)
    if not total:
        runs.add(lines)
    common = runs.all_common()
    often = common.where(F.col("h1").isin([r.h1 for r in often])).collect() if often else []

    known = lambda x: x["h1"].isin([r.h1 for r in often]) & x["h2"].isin([r.h2 for r in often])
    split = lambda rows: rows.withColumn("s", hashes(F.col("text"), min_chars))
    others = split(rows).select("own_1", "own_2", F.explode_outer("s").alias("x")).where(F.col("x").isNotNull() & ~known(F.col("x")))  # outer: no filter that makes the hashes twice
    hits = others.select("own_1", "own_2", "x.h1", "x.h2", "x.pos").join(common.hint("merge"), list(HASH))
    hits = hits.groupBy("own_1", "own_2").agg(F.collect_set("pos").alias("hits"))  # one document's lines
    judged = split(rows.join(hits.hint("merge"), ["own_1", "own_2"], "left"))
    none = F.array().cast("array<int>")
    gone = F.sort_array(F.concat(F.coalesce("hits", none), F.filter("s", known)["pos"]))
    judged = judged.select("own_id", lines_of(F.col("text")).alias("all_lines"), gone.alias("gone"))
    flags = F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    left = F.zip_with("all_lines", F.flatten(flags), lambda line, drop: F.when(F.coalesce(drop, F.lit(False)), F.lit(None)).otherwise(line))
    return judged.select(F.col("own_id").alias("doc_id"), F.size("all_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(left, "\n").alias("text"))
