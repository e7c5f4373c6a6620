"""From raw documents to training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's docs. All but the last return
the columns of ``documents``. None of the stages can be said in SQL (tokenisers,
suffix arrays), so ORACLE_SQL is None and tests hold them against plain versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import jaccard_join, packing, quality_rules, suffix_dedup
from quillgraph.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the word rules or their language's fertility band go."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fifty bytes and more that a document with a smaller id has go from the text."""
    return suffix_dedup.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none across documents."""
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("packing", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
