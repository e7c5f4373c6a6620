"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from quillgraph.plans import queries
from quillgraph.plans.registry import FLAGSHIP, ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(sql.execute(ORACLES[name]).df())


def test_known_vectors_are_whole(spark, sql):
    want = sql.execute("SELECT vec_id, CASE WHEN label < 5 THEN embedding[2:] || embedding[1:1] ELSE embedding END AS v FROM embeddings").fetchall()
    found = [(r.vec_id, r.embedding) for r in queries.known_vectors(spark, DATA).collect()]
    assert sorted(found) == sorted(want) and all(len(v) == 64 for _, v in found)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", ["chunks_per_doc", "chunk_embeddings", "page_markdown", "page_records"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
