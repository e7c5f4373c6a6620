"""Vectors: similarity, exact nearest neighbours, means, pair joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + d)


TILE = 2048  # rows of a matrix product
STEP = 1 << 16  # pairs that are scored at a time
NEAR = 1e-9  # more than products of unit vectors are off by

METRICS = {"cosine": cosine, "l2sq": l2_similarity}


def nearest(vectors: DataFrame, query: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows most similar to the one row of ``query`` (column query_vec), ties to
    the smaller id; rows without a vector take no part, and more than one query is an
    error. A scan with a partial top-k in each task."""
    one = query.agg(F.count(F.lit(1)).alias("n"), F.first("query_vec").alias("query_vec"))
    one = one.select(F.when(F.col("n") > 1, F.raise_error(F.lit("nearest: more than one query"))).otherwise(F.col("query_vec")).alias("query_vec"))
    rows = vectors.where(F.col(vec_col).isNotNull()).crossJoin(F.broadcast(one)).where(F.col("query_vec").isNotNull())  # one row
    return rows.select(F.col(id_col), METRICS[metric](F.col(vec_col), F.col("query_vec")).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def mean_vector(vectors: DataFrame, vec_col: str = "embedding", by: tuple[str, ...] = ()) -> DataFrame:
    """The element-wise mean, of all rows or by key, as query_vec."""
    each = vectors.select(*by, F.posexplode(vec_col).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("query_vec"))  # one vector's elements


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, pivots: int = 64, sample: int = 1024) -> DataFrame:
    """a < b, sim: all pairs of cosine ``threshold`` and more (inclusive).

    Vectors are dealt into blocks, and each pair of blocks is one group, which multiplies
    tiles of them. So a vector is sent once a block (of 2,048 to 16,384 rows, as many as
    give every core a group), and only once where one block holds all.

    Where there are several blocks, they are blocks of cells around a few vectors (at most
    ``pivots``, those of least hash). A vector then goes to a cell only if it can have a
    neighbour there: angles obey the triangle inequality, so its angle to the cell's
    pivot is at most the cell's radius and the threshold's angle. That is exact. It pays
    where vectors form clusters; where a drawn ``sample`` says that less than a tenth
    would be skipped, blocks are dealt by hash. No task or broadcast grows with the
    data. Rows without a vector, or with one of no length, take no part; all have one
    length.
    """
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(size > 0)
    n = rows.count()
    wide = int((2 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1
    block = block or min(16384, max(TILE, -(-n // wide)))
    one = F.lit(0).cast("long")
    if n <= block:
        return rows.select(one.alias("p"), one.alias("q"), one.alias("mine"), "id", "v").groupBy("p", "q").applyInArrow(pairs_of_blocks(threshold), "a long, b long, sim double")

    drawn = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], float)  # ``sample`` vectors
    around = drawn[: min(pivots, -(-n // block))]
    around = around / np.linalg.norm(around, axis=1, keepdims=True)

    def angles(v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip((v / np.linalg.norm(v, axis=1, keepdims=True)) @ around.T, -1, 1))

    def placed(batches):
        for batch in batches:
            if len(batch):
                angle = angles(matrix(batch.column(1)))
                cell = angle.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])], names=["cell", "angle"])

    cells = {r.cell: (r.n, r.radius) for r in rows.mapInArrow(placed, "cell int, angle double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    held = np.array([cells[c][0] if c in cells else 0 for c in range(len(around))])
    reach = np.array([cells[c][1] if c in cells else -np.inf for c in range(len(around))]) + np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    if ((angles(drawn) <= reach) @ held).sum() > 0.9 * n * len(drawn):  # hardly any would be skipped
        held, reach = np.array([n]), np.array([np.inf])
        around = around[:1]
    blocks = -(-held // block)
    first = np.cumsum(blocks) - blocks

    def dealt(batches):
        """Each vector with its block and the blocks of all cells in its reach."""
        for batch in batches:
            if not len(batch):
                continue
            ids, angle = batch.column(0).to_numpy(), angles(matrix(batch.column(1)))
            cell = angle.argmin(1)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            own = first[cell] + (mixed % np.maximum(blocks[cell], 1).astype(np.uint64)).astype(np.int64)
            near = angle <= reach
            others = [np.concatenate([np.arange(first[c], first[c] + blocks[c]) for c in np.flatnonzero(row)]) if row.any() else first[:0] for row in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names=["id", "v", "mine", "others"])

    sent = rows.mapInArrow(dealt, "id long, v array<double>, mine long, others array<long>").withColumn("other", F.explode("others"))
    sent = sent.select(F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "id", "v")
    return sent.groupBy("p", "q").applyInArrow(pairs_of_blocks(threshold), "a long, b long, sim double")


def pairs_of_blocks(threshold: float):
    """The similar pairs of a group of two blocks (or of one), a product of tiles at a time."""

    def product(cell: pa.Table) -> pa.Table:
        p, q, mine, ids = cell["p"][0].as_py(), cell["q"][0].as_py(), cell["mine"].to_numpy(), cell["id"].to_numpy()
        v = matrix(cell["v"])
        norm = np.sqrt((v * v).sum(1))
        unit = v / norm[:, None]
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        found = [pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})]
        for x in (left[i : i + TILE] for i in range(0, len(left), TILE)):
            for y in (right[i : i + TILE] for i in range(0, len(right), TILE)):
                i, j = np.nonzero(unit[x] @ unit[y].T >= threshold - NEAR)  # one pass over a tile; the few are scored anew
                i, j = x[i], y[j]
                keep = ids[i] < ids[j] if p == q else ids[i] != ids[j]
                i, j = i[keep], j[keep]
                sim = np.concatenate([np.einsum("nd,nd->n", v[i[k : k + STEP]], v[j[k : k + STEP]]) for k in range(0, len(i), STEP)] or [np.zeros(0)]) / (norm[i] * norm[j])
                keep = sim >= threshold
                ends = ids[i[keep]], ids[j[keep]]
                found.append(pa.table({"a": np.minimum(*ends), "b": np.maximum(*ends), "sim": sim[keep]}))
        return pa.concat_tables(found)

    return product


def best_of_blocks(asked: DataFrame, rows: DataFrame, keys: list[str], k: int, metric: str, schema: str) -> DataFrame:
    """query_id, id, score: the k best rows (id, v) of each query (query_id, v), of each
    group of the keys. A group is one matrix product; queries and rows of one key are
    as many as its block is large."""

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = matrix(left["v"]).astype(float), matrix(right["v"]).astype(float)
        if metric == "cosine":
            score = (x @ y.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :], 1e-300)
        else:  # differences, not squares: near neighbours keep their digits
            score = np.stack([1 / (1 + ((y - row) ** 2).sum(1)) for row in x])
        ids = right["id"].to_numpy()
        best = [np.lexsort((ids, -row))[:k] for row in score]
        of = np.repeat(np.arange(len(best)), [len(b) for b in best])
        at = np.concatenate(best)
        return pa.table({"query_id": left["query_id"].take(pa.array(of)), "id": pa.array(ids[at], pa.int64()), "score": score[of, at]})

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(product, schema)


def over_threshold(asked: DataFrame, rows: DataFrame, keys: list[str], threshold: float, metric: str) -> DataFrame:
    """query_id, id: the rows (id, v) that score ``threshold`` or more with a query
    (query_id, v) of the same group of the keys, each pair once a group. A group is as
    large as a block; its product is taken in tiles."""

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})]
        if left.num_rows and right.num_rows:
            asked_ids, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
            x, y = matrix(left["v"]).astype(float), matrix(right["v"]).astype(float)
            xs, ys = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            for a in range(0, len(x), TILE):
                for b in range(0, len(y), TILE):
                    p, q = slice(a, a + TILE), slice(b, b + TILE)
                    if metric == "cosine":
                        score = (x[p] @ y[q].T) / (xs[p][:, None] * ys[q][None, :])
                    else:
                        score = np.stack([1 / (1 + ((y[q] - row) ** 2).sum(1)) for row in x[p]])
                    i, j = np.nonzero(score >= threshold)
                    ends = np.unique(np.stack([asked_ids[p][i], ids[q][j]]), axis=1)
                    found.append(pa.table({"query_id": ends[0], "id": ends[1]}))
        return pa.concat_tables(found)

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(product, "query_id long, id long")


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, vec_id, score, rank: cosine neighbours of a table of queries
    (query_id, query_vec), blocks against blocks."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("v"))
    n, m = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // block))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    found = best_of_blocks(asked, rows.withColumnRenamed("vec_id", "id"), ["p", "q"], k, "cosine", "query_id long, id long, score double").withColumnRenamed("id", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)
