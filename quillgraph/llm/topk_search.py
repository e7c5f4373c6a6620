"""Exact top-k inner-product search by no-random-access (NRA) aggregation.

Fagin, Lotem and Naor, "Optimal aggregation algorithms for middleware" (2003).
Every dimension of a block of candidates is a list sorted by value; a query
reads it from the top where its own component is positive, from the bottom
where it is negative. Lists are read in stretches, all to the same depth, and
what is read is added to a sum for each query and candidate. After a stretch a
candidate has

* a lower bound: its sum, plus the worst value of each list not yet seen;
* an upper bound: its sum, plus the value at each list's reading point.

A candidate whose upper bound is below the k-th best lower bound is out. One that
is out for all queries of the block leaves the lists, and reading goes on for the
others until the lists end: their sums are then their scores. No vector is ever
looked up as a whole.

Scale: candidates and queries are dealt into blocks of bounded size and each
pair of blocks is one task, so no task and no broadcast grows with the data; a
task goes through its queries some hundreds at a time. The work is
|queries| x |rows| by the nature of an exact search.

Components so large that a sum of products could leave the exact integers of a
double are a block of their own: bounds then allow for rounding, and what was read
for the few candidates left is summed in integers of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship

#: How many stretches the lists are read in, and how many queries at a time.
STRETCHES, TOGETHER = 8, 512
#: Products of two components, summed, stay exact in a double below this.
EXACT = float(2**53)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>, dims): floor(scale * x); rows that take no part are gone.

    Null ids, null or empty vectors and vectors with null or non-finite
    components take no part.
    """
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & good)
    whole = lambda e: F.when(F.abs(e) < EXACT, F.floor(F.when(F.abs(e) < EXACT, e)).cast("double")).otherwise(e)  # noqa: E731  (larger doubles have no fraction)
    return rows.select("vec_id", F.transform("x", lambda e: whole(e * scale)).alias("v"), F.size("x").alias("dims"))


class Lists:
    """The sorted lists of a block of candidates, downwards and upwards: what each
    holds of a candidate, how deep it stands, and the values in reading order."""

    def __init__(self, c: np.ndarray):
        n, dims = c.shape
        order = np.argsort(-c, axis=0, kind="stable")
        depth = np.empty((dims, n), np.int32)
        np.put_along_axis(depth, order.T, np.arange(n, dtype=np.int32)[None, :].repeat(dims, 0), axis=1)
        down = np.take_along_axis(c, order, 0).T
        self.n = n
        self.held = np.vstack([c.T, c.T])
        self.depth = np.vstack([depth, n - 1 - depth])
        self.values = np.vstack([down, down[:, ::-1]])
        self.worst = self.values[:, -1]
        self.largest = np.abs(self.values[:, [0, -1]]).max(1)


def nra(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, lists: Lists, k: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best in the block, ties to smaller
    ids. ``wide``: sums aren't exact, and a best score that no long holds is an
    OverflowError."""
    n = lists.n
    signed = np.hstack([np.maximum(q, 0.0), np.minimum(q, 0.0)])  # zero: the list isn't read
    slack = np.abs(signed) @ lists.largest[:, None] * (q.shape[1] * 2.0**-49) if wide else 0.0
    columns = np.arange(n)
    held, depth = lists.held, lists.depth
    alive = qid[:, None] != cid[None, :]
    total = np.zeros((len(q), n))
    at = 0
    while at < n:
        to = min(n, at + -(-n // STRETCHES))
        total += signed @ np.where((depth >= at) & (depth < to), held, 0.0)
        at = to
        unseen = (depth >= at).astype(float)
        low = total + (signed * lists.worst) @ unseen - slack
        high = total + (signed * lists.values[:, min(at, n - 1)]) @ unseen + slack
        low[~alive] = -np.inf
        if len(columns) > k:
            kth = np.partition(low, len(columns) - k, axis=1)[:, len(columns) - k]
            alive &= ~(high < kth[:, None])  # what isn't a number stays
        keep = alive.any(0)
        if 2 * keep.sum() <= len(columns):
            columns, held, depth, alive, total = columns[keep], held[:, keep], depth[:, keep], alive[:, keep], total[:, keep]
    names = cid[columns]
    rows = []
    for i in range(len(qid)):
        left = np.flatnonzero(alive[i])
        if wide:
            mine = [(d, int(x)) for d, x in enumerate(signed[i]) if x]
            scored = sorted((-sum(x * int(held[d, j]) for d, x in mine), int(names[j])) for j in left)[:k]
            rows += [(qid[i], j, -score) for score, j in scored]
        else:
            score = total[i, left]
            best = np.lexsort((names[left], -score))[:k]
            rows += zip([qid[i]] * len(best), names[left][best], score[best].astype(np.int64))
    return tuple(np.array([r[x] for r in rows], np.int64) for x in range(3))


def block_best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best among the candidates of usual size, and among the others."""
    with np.errstate(over="ignore", invalid="ignore"):
        q_wide, c_wide = (np.abs(x).max(1) ** 2 * x.shape[1] >= EXACT for x in (q, c))
        found = []
        for large in (False, True):
            if not (c_wide == large).any():
                continue
            own = c_wide == large
            lists = Lists(c[own])
            for wide in (False, True):
                these = np.flatnonzero(q_wide == wide)
                for i in range(0, len(these), TOGETHER):
                    part = these[i : i + TOGETHER]
                    found.append(nra(qid[part], q[part], cid[own], lists, k, wide or large))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def topk_search(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 8192, cand_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates.

    Ties go to the smaller vec_id; a candidate with the query's own id is left
    out. Repeated query ids count once (the least vector stands for them);
    repeated candidate rows are rows of their own. Vectors of different lengths
    are never compared. A best score that no long holds is an error. Empty inputs give no rows. Extra columns are ignored.
    """
    spark = queries.sparkSession
    ship(spark)
    q = quantised(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min(F.struct("v", "dims")).alias("s")).select("vec_id", "s.v", "s.dims")
    c = quantised(candidates, id_col, vec_col, scale)
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // cand_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    q = q.withColumn("qb", block(q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = c.withColumn("cb", block(c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        out = block_best(left.vec_id.to_numpy(), np.array(left.v.tolist(), float), right.vec_id.to_numpy(), np.array(right.v.tolist(), float), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    keys = ("qb", "cb", "dims")
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
