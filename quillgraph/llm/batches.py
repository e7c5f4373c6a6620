"""Texts packed into batches of bounded size, in a table of the shared folder.

Operators that ask a corpus-wide question about the parts of texts (is this
string elsewhere?) send a batch's distinct parts out, by slice, and take the
answers back by batch. The batch number is stored with the texts, so that a lost
executor's work is done again on the same batches.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, tidy

SCHEMA = "batch long, texts binary, lengths binary, ids array<long>"


def write_packed(docs: DataFrame, path: str, id_col: str, text_col: str, batch_bytes: int, carry: tuple[str, ...] = (), buckets: int = 0) -> DataFrame:
    """batch, texts (compressed, one after another), lengths, ids: null texts are
    empty. The columns ``carry`` follow as arrays c0, c1, ... With ``buckets`` the table
    is bucketed by batch, so that answers by batch meet the texts where they are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    more = [f"c{i}" for i in range(len(carry))]
    schema = SCHEMA + "".join(f", {m} array<{docs.schema[c].dataType.simpleString()}>" for m, c in zip(more, carry, strict=True))

    def pack(batches):
        seq = 0
        for batch in batches:
            at = 0
            for ids, texts in batches_of_texts([batch], batch_bytes):
                part = batch.column(2)[at].as_py()
                carried = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), c.slice(at, len(texts))) for c in batch.columns[3:]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 24 | seq]), pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()), pa.array([np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()], pa.binary()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *carried],
                    names=["batch", "texts", "lengths", "ids", *more],
                )
                seq += 1

    writer = rows.mapInArrow(tidy(pack), schema).write.option("compression", "none")
    if buckets:
        name = f"packed_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, "batch").option("path", path).saveAsTable(name)
        return docs.sparkSession.table(name)
    writer.parquet(path)
    return docs.sparkSession.read.parquet(path)


def unpacked(texts: bytes, lengths: bytes) -> list[bytes]:
    flat, at, out = zstandard.decompress(texts), 0, []
    for n in np.frombuffer(lengths, np.int64).tolist():
        out.append(flat[at : at + n])
        at += n
    return out


def slices_for(batches: int) -> int:
    """As many as batches, so that a slice holds about as much as a batch at any size; a
    batch sends rows to those that it has something of."""
    return max(48, batches)


def rows_of(batches):
    for batch in batches:
        yield from batch.to_pylist()


def grouped(which: np.ndarray, slices: int) -> list[np.ndarray]:
    """The indices of each slice."""
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(slices + 1))
    return [order[a:b] for a, b in zip(cuts, cuts[1:])]
