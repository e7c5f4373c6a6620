"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is
    unset, a temporary one on a local master, as in tests; on a cluster, whose
    executors couldn't see it, an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgraph-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder. A checkpoint keeps the estimated size of its plan,
    a number whose digits multiply with every join of a long iteration; a table has
    the size of its files."""
    path = f"{shared_dir(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer partitions than there are cores (small files) over all of them,
    ahead of work that costs more than moving them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
