"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import inspect
import io
import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]

#: ASCII white space, the only bytes that separate words in the contracts.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers.

    Nothing happens where PYTHONPATH already has it, as on a cluster with an
    installed package. Otherwise a zip of the package is handed to Spark's own
    file server once a session.
    """
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_quillgraph_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted((ROOT / "quillgraph").rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(ROOT))), p.read_bytes())
    data = buffer.getvalue()
    to = Path(tempfile.mkdtemp()) / f"quillgraph-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    to.write_bytes(data)
    before = list(sys.path)
    sc.addPyFile(str(to))
    sys.path[:] = before  # the driver keeps its own copy
    sc._quillgraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is
    unset, a temporary one on a local master, as in tests; on a cluster, whose
    executors couldn't see it, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="quillgraph-checkpoints-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it from there: its
    lineage is cut, so that a lost executor costs no recomputation of what lies before.
    A checkpoint would do that as well, but keeps the estimated size of its plan, a
    number whose digits double with every join of a long iteration. ``by``: columns
    whose values have a folder each."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of_texts(batches, limit: int = 16 << 20):
    """(ids array, list of byte texts) of at most ``limit`` bytes, or one text if longer."""
    for batch in batches:
        ids = batch.column(0)
        texts = batch.column(1).cast(pa.binary())
        start, held = 0, 0
        out: list[bytes] = []
        for i, text in enumerate(texts):
            value = text.as_py() or b""
            if out and held + len(value) > limit:
                yield ids.slice(start, i - start), out
                start, held, out = i, 0, []
            out.append(value)
            held += len(value)
        if out:
            yield ids.slice(start, len(out)), out


def give_back() -> None:
    """Returns what this worker has freed to the system. Idle workers stay alive
    beside busy ones, with all that their allocators keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run`` over a task's batches, that gives memory back at the end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run):
    """``run`` on the tables of a group, that gives memory back at its end."""

    def one(table):
        try:
            return run(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return two if len(inspect.signature(run).parameters) == 2 else one


_held: dict = {}


def held(make, *args):
    """``make(*args)``, once a worker process. Workers go from operator to operator:
    what another one held (vocabularies, cached words) is let go."""
    if any(other is not make for other, *_ in _held):
        _held.clear()
    if (make, *args) not in _held:
        _held[make, *args] = make(*args)
    return _held[make, *args]


class Recent:
    """A bounded look-up table of what was asked for lately: two generations of at
    most ``size`` entries and what one request adds. A key that is asked for again
    moves to the younger one; the older one goes when that is full."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """The keys that must be put before ``young`` has all of them."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        absent = keys.difference(self.young)
        again = absent.intersection(self.old)
        self.young.update((k, self.old[k]) for k in again)
        return list(absent - again)


__all__ = ["WORD", "Recent", "batches_of_texts", "cut", "give_back", "held", "shared_dir", "ship", "table", "text_or_empty", "tidy", "tidy_group"]
