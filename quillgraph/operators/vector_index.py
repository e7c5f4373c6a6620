"""A stored vector index: an inverted file by cells, searched exactly.

``build`` draws centres by k-means from a bounded sample, deals every vector to its
nearest centre and writes it there (``cells/cell=../batch=..``), with its distance to
the centre; ``ranges`` has the least and the greatest of these. Distances obey the
triangle inequality, so no vector of a cell is nearer to a query than the difference of
the query's distance to the centre and that range. A search reads the cells around the
query until it has k rows, and then of the others only those, and in them only the
vectors, that can be nearer than the k-th. Results are those of a scan, ties included;
centres decide how much is read, not what is found.

Cosine works on angles, l2sq on Euclidean distances. Rows without a vector, with one of
other than finite components, or for cosine with one of no length, aren't in the index.
Ids are expected to be unique: one that is added twice is found twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import written
from .vector import best_of_blocks, matrix, nearest, over_threshold

#: Angles near 0 and pi have about half of a double's digits.
SLACK = 1e-6
MAX_CELLS = 4096
RANGES = "cell int, batch long, n long, least double, most double"


def usable(v: Column, metric: str) -> Column:
    """Neither null nor empty, all components finite, and a length where angles need one."""
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return finite & F.exists(v, lambda x: x != 0) if metric == "cosine" else finite


def distances(v: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of ``v`` to each centre."""
    if metric == "cosine":
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, centres))
        return np.arccos(np.clip(a @ b.T, -1, 1))
    square = (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (v @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def distance_of(score: float, metric: str) -> float:
    """The distance of a row with this score; infinite for a score of no row."""
    if score is None:
        return np.inf
    return float(np.arccos(np.clip(score, -1, 1))) if metric == "cosine" else float(np.sqrt(max(1 / max(score, 1e-300) - 1, 0)))


def centres_of(rows: DataFrame, cells: int, metric: str, sample: int) -> np.ndarray:
    """k-means over the ``sample`` rows of least hash."""
    v = F.col("v")
    if metric == "cosine":  # of one length, as only angles count
        v = F.transform(v, lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)))
    drawn = written(rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(v).alias("features")))
    found = KMeans(k=cells, seed=1, maxIter=8, initMode="random").fit(drawn).clusterCenters() if cells > 1 else []
    found = [c for c in found if metric != "cosine" or np.linalg.norm(c) > 0]
    return np.array(found if found else drawn.limit(1).collect()[0].features.toArray()[None, :], float)


@dataclass(frozen=True)
class Found:
    rows: DataFrame  # the best, with their scores
    cells: int  # in the index
    read: tuple[int, ...]  # cells that were read


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").head()
        self.metric, self.id_type, self.vec_type = about.metric, about.id_type, about.vec_type
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MAX_CELLS rows at most
        self.centres = np.array([r.centre for r in rows], float)

    @staticmethod
    def build(vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", batch: int = 0) -> VectorIndex:
        """Writes the index of a table, as ``batch``. ``cells``: the square root of its rows,
        at most 4,096; ``sample``: 64 rows a cell. All vectors have one number of components."""
        spark = vectors.sparkSession
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v"), metric)).withColumn("v", F.col("v").cast("array<double>"))
        n = rows.count()
        cells = min(MAX_CELLS, max(1, min(n, cells or int(n**0.5))))
        centres = centres_of(rows, cells, metric, sample or 64 * cells) if n else np.zeros((0, 0))
        spark.createDataFrame([(metric, kinds[id_col], kinds[vec_col])], "metric string, id_type string, vec_type string").write.mode("overwrite").parquet(f"{path}/about")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        for name, schema, by in (("cells", f"id {kinds[id_col]}, v {kinds[vec_col]}, away double, cell int, batch long", ["cell", "batch"]), ("ranges", RANGES, ["batch"])):
            spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
        index = VectorIndex(spark, path)
        if n:
            index.add(vectors, batch, id_col, vec_col)
        return index

    def add(self, vectors: DataFrame, batch: int, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Adds a batch, by its number: one that is added again is written again, not twice.
        Centres stay; ranges grow with what comes. A cell of many rows is many files."""
        centres, metric = self.centres, self.metric
        if not len(centres):
            raise ValueError("an index of no vectors has no cells to add to: build it anew")
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v"), metric))

        def placed(batches):
            for b in batches:
                if b.num_rows:
                    away = distances(matrix(b.column(1)).astype(float), centres, metric)
                    cell = away.argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(away[np.arange(len(cell)), cell]), pa.array(cell, pa.int32())], names=["id", "v", "away", "cell"])

        dealt = rows.mapInArrow(placed, f"id {self.id_type}, v {self.vec_type}, away double, cell int").withColumn("batch", F.lit(batch).cast("long"))
        out = dealt.hint("rebalance", "cell").sortWithinPartitions("cell", "away").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("cell", "batch").parquet(f"{self.path}/cells")
        own = self.rows().where(F.col("batch") == batch).groupBy("cell", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        own.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/ranges")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, v {self.vec_type}, away double, cell int, batch long").parquet(f"{self.path}/cells")

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, n, least, most) of the cells that have rows."""
        found = self.spark.read.schema(RANGES).parquet(f"{self.path}/ranges").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        rows = found.orderBy("cell").collect()  # MAX_CELLS rows at most
        return np.array([r.cell for r in rows], int), np.array([r.n for r in rows], int), np.array([r.least for r in rows], float), np.array([r.most for r in rows], float)

    def search(self, query: DataFrame, k: int, most_cells: int | None = None) -> Found:
        """The k rows most similar to the one row of ``query`` (column query_vec), ties
        to the smaller id. With ``most_cells`` only so many cells are read, the nearest
        ones, and rows beyond them may be missed."""
        asked = [r.query_vec for r in query.select("query_vec").limit(2).collect()]
        if len(asked) > 1:
            raise ValueError("search: more than one query")
        cell, n, least, most = self.ranges()
        if not asked or asked[0] is None or not len(cell) or k < 1:
            return Found(self.scored(self.rows().where("false"), query, max(k, 0)), len(cell), ())
        q = np.array([asked[0]], float)
        if self.metric == "cosine" and not q.any():  # no angle: no score
            return Found(self.scored(self.rows(), query, k), len(cell), tuple(map(int, cell)))
        away = distances(q, self.centres[cell], self.metric)[0]
        bound = np.maximum(0, np.maximum(away - most, least - away)) - SLACK
        order = np.lexsort((away, bound))[: most_cells or len(cell)]
        first = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
        near = written(self.scored(self.rows().where(F.col("cell").isin(cell[first].tolist())), query, k))
        scores = [r.score for r in near.select("score").collect()]  # k rows
        reach = distance_of(min(scores), self.metric) + SLACK if len(scores) == k and None not in scores else np.inf
        rest = np.array([i for i in order[len(first) :] if bound[i] <= reach], int)
        if not len(rest):
            return Found(near, len(cell), tuple(map(int, cell[first])))
        to_centre = F.element_at(F.map_from_arrays(F.lit(cell[rest].tolist()), F.lit(away[rest].tolist())), F.col("cell"))
        others = self.rows().where(F.col("cell").isin(cell[rest].tolist()))
        if np.isfinite(reach):
            others = others.where(F.col("away").between(float((away[rest] - reach).min()), float((away[rest] + reach).max())) & (F.abs(F.col("away") - to_centre) <= float(reach)))
        both = near.unionByName(self.scored(others, query, k)).orderBy(F.desc("score"), "id").limit(k)
        return Found(both, len(cell), tuple(map(int, cell[[*first, *rest]])))

    def scored(self, rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
        return nearest(rows, query, k, self.metric, "id", "v")

    def search_many(self, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
        """query_id, id, score, rank: the k nearest of a table of queries (query_id,
        query_vec), by cosine or 1 / (1 + squared distance). Queries without a usable
        vector have no rows. Each goes to its nearest cells until these have k rows,
        and then to the cells that can have nearer ones than its k-th; cells of many
        rows, or many queries, are met in blocks."""
        metric, centres = self.metric, self.centres
        cell, n, least, most = self.ranges()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("v")).where(usable(F.col("v"), metric) & F.col("query_id").isNotNull())
        found = "query_id long, id long, score double"
        if not len(cell):
            return asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where("false")

        def sent(rest: bool):
            """Each query with its cells: those around it, or those of the others in reach."""

            def run(batches):
                for b in batches:
                    if not b.num_rows:
                        continue
                    away = distances(matrix(b.column("v")), centres[cell], metric)
                    bound = np.maximum(0, np.maximum(away - most, least - away)) - SLACK
                    reach = b.column("reach").to_numpy(zero_copy_only=False) if rest else None
                    take, to = [], []
                    for i in range(b.num_rows):
                        order = np.lexsort((away[i], bound[i]))
                        near = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                        chosen = order[near:][bound[i][order[near:]] <= reach[i]] if rest else order[:near]
                        take += [i] * len(chosen)
                        to += cell[chosen].tolist()
                    at = pa.array(take, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("v").take(at), pa.array(to, pa.int32())], names=["query_id", "v", "cell"])

            return run

        size = dict(zip(cell.tolist(), (-(-n // block)).tolist()))
        blocks_of = lambda col: F.element_at(F.map_from_arrays(F.lit(list(size)), F.lit([int(x) for x in size.values()])), F.col(col))
        rows = self.rows().select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), "cell")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), blocks_of("cell")).cast("int"))

        def best(dealt: DataFrame) -> DataFrame:
            dealt = written(dealt)
            many = {r.cell: -(-r.n // block) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_CELLS rows at most
            if not many:
                return self.spark.createDataFrame([], found)
            groups = F.element_at(F.map_from_arrays(F.lit(list(many)), F.lit([int(x) for x in many.values()])), F.col("cell"))
            left = dealt.withColumn("group", F.pmod(F.xxhash64("query_id"), groups).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), blocks_of("cell").cast("int") - 1)))
            right = rows.where(F.col("cell").isin(list(many))).withColumn("group", F.explode(F.sequence(F.lit(0), groups.cast("int") - 1)))
            return best_of_blocks(left, right, ["cell", "part", "group"], k, metric, found)

        first = written(best(asked.mapInArrow(sent(False), "query_id long, v array<double>, cell int")))
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        kth = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
        away = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))) if metric == "cosine" else F.sqrt(F.greatest(1 / F.col("score") - 1, F.lit(0.0)))
        reach = kth.select(F.col("query_id").alias("of"), (away + SLACK).alias("reach"))
        again = asked.join(reach, F.col("query_id") == F.col("of"), "left").select("query_id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        every = first.unionByName(best(again.mapInArrow(sent(True), "query_id long, v array<double>, cell int")))
        return every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")

    def within(self, queries: DataFrame, threshold: float, names: DataFrame | None = None, before: int | None = None, block: int = 4096) -> DataFrame:
        """query_id, id: all rows whose score with a query of the table (query_id,
        query_vec) is ``threshold`` or more (inclusive), of the batches below ``before``.
        With ``names`` (id, name) a row goes by its name, if it has one, and a query meets
        a name once in a block of rows, however many rows have it.

        A query goes only to cells that can have such a row. Small cells are met together,
        as many as make a block, and large ones in blocks, so that a query is sent at most
        once a block of rows, as it would be without cells.
        """
        metric, centres = self.metric, self.centres
        cell, n, least, most = self.ranges()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("v")).where(usable(F.col("v"), metric) & F.col("query_id").isNotNull())
        if not len(cell):
            return asked.select("query_id", F.col("query_id").alias("id")).where("false")
        group, parts, room = {}, [], 0
        for c, rows in zip(cell.tolist(), n.tolist()):
            if rows > room:
                parts.append(-(-rows // block))
                room = max(block, rows)
            group[c] = len(parts) - 1
            room = room - rows if rows <= block else 0
        of_cell = np.array([group[c] for c in cell.tolist()], int)
        reach = distance_of(threshold, metric) + SLACK

        def sent(batches):
            for b in batches:
                if b.num_rows:
                    away = distances(matrix(b.column("v")), centres[cell], metric)
                    near = (away <= most + reach) & (away >= least - reach)
                    to = [np.unique(of_cell[row]) for row in near]
                    at = pa.array(np.repeat(np.arange(len(to)), [len(t) for t in to]), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("v").take(at), pa.array(np.concatenate(to), pa.int32())], names=["query_id", "v", "cells"])

        dealt = written(asked.mapInArrow(sent, "query_id long, v array<double>, cells int"))
        many = {r.cells: -(-r.n // block) for r in dealt.groupBy("cells").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_CELLS rows at most
        read = [c for c in cell.tolist() if group[c] in many]
        if not read:
            return dealt.select("query_id", F.col("query_id").alias("id")).where("false")
        upto = lambda counts, col: F.element_at(F.map_from_arrays(F.lit(list(counts)), F.lit([int(x) for x in counts.values()])), F.col(col))
        rows = self.rows().where(F.col("cell").isin(read))
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), upto({c: group[c] for c in read}, "cell").cast("int").alias("cells"))
        if names is not None:
            rows = rows.join(names.select("id", "name"), "id", "left").select(F.coalesce("name", "id").alias("id"), "v", "cells")
        size = {g: parts[g] for g in many}
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), upto(size, "cells")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), upto(many, "cells").cast("int") - 1)))
        left = dealt.withColumn("turn", F.pmod(F.xxhash64("query_id"), upto(many, "cells")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), upto(size, "cells").cast("int") - 1)))
        return over_threshold(left, rows, ["cells", "part", "turn"], threshold, metric).distinct()
