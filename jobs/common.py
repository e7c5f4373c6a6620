"""What the jobs share: configuration, sessions, counts for the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with the file's values; a name that isn't among them is an error."""
    if not path:
        return dict(defaults)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    given = json.loads(text)
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"{path}: unknown settings {unknown}")
    return defaults | given


def counted(df: DataFrame, name: str, *more) -> tuple[DataFrame, Observation]:
    """The rows, which an action on them also counts, and where their count is found."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def main(run: Callable[..., dict], paths: tuple[str, ...], defaults: dict, argv: list[str] | None = None) -> dict:
    """The command line: a session is made and stopped here alone."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--config")
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        return run(spark, *[getattr(args, name) for name in paths], configured(spark, args.config, defaults))
    finally:
        spark.stop()
