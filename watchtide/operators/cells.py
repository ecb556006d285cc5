"""Exact search of many queries over an inverted file of cells.

Points go to the cell of the nearest centroid; a cell knows its widest angle to the
centroid. By the triangle inequality of angles, a query at angle t from the centroid finds
nothing in a cell of width w that is more similar than cos(t - w). A first round looks at
each query's nearest cells; the similarity of its last hit then rules out every cell whose
bound lies below, and a second round looks at the rest. Nothing is lost, whatever the
centroids are.

Points are shuffled by cell, once a round, and never copied; a query goes to the cells it
looks at. In a task the points of a cell (in blocks of about ``BLOCK``) meet the queries in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.session import stored

CELLS = 64
SAMPLE = 20_000
PROBES = 3
BLOCK = 16_384
#: Angles are rounded; the bound leaves so much room.
ROOM = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), np.finfo(float).tiny)


def _table(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)


def _angles(similarity: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(similarity, -1.0, 1.0))


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means, ten steps from evenly chosen distinct points."""
    points = np.unique(unit(sample), axis=0)
    centers = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(10):
        near = (points @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        some = np.linalg.norm(sums, axis=1) > 0
        centers[some] = unit(sums[some])
    return centers


class CellIndex:
    """Points by cell; ``id_col`` and ``embedding`` are read."""

    def __init__(self, points: DataFrame, id_col: str = "id", cells: int = CELLS, sample: int = SAMPLE):
        self.id_type = points.schema[id_col].dataType
        rows = points.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"]
        self.empty = not len(chosen)
        if self.empty:
            return
        self.centers = centers = _centroids(_table(chosen), cells)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _table(batch.column(1))
                    similarity = unit(v) @ centers.T
                    cell = similarity.argmax(axis=1)
                    # A zero vector has no direction: its similarity is 0 everywhere.
                    width = np.where((v == 0).all(axis=1), np.pi, _angles(similarity.max(axis=1)))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(width)], ["id", "v", "cell", "width"]
                    )

        form = T.StructType(
            [rows.schema["id"], rows.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("width", T.DoubleType())]
        )
        self.points = stored(rows.mapInArrow(place, form), "cells")
        told = self.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).toArrow().to_pydict()
        self.size, self.width = np.zeros(len(centers), np.int64), np.full(len(centers), -np.inf)
        self.size[told["cell"]], self.width[told["cell"]] = told["n"], told["w"]

    def visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, v, cell of every look: the nearest cells where ``need`` is null, else the other
        cells that may hold a similarity of ``need`` or more."""
        centers, size, width = self.centers, self.size, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    similarity = unit(_table(batch.column(1))) @ centers.T
                    nearest = np.where(size > 0, similarity, -2.0).argsort(axis=1, kind="stable")[:, ::-1][:, :probes]
                    first = np.zeros(similarity.shape, dtype=bool)
                    np.put_along_axis(first, nearest, True, axis=1)
                    first &= size > 0
                    need = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                    bound = np.cos(np.maximum(_angles(similarity) - width[None, :], 0.0)) + ROOM
                    look = np.where(np.isnan(need)[:, None], first, ~first & (size > 0) & (bound >= need[:, None]))
                    who, cell = np.nonzero(look)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.take(pa.array(who)).columns[:2], pa.array(cell.astype(np.int32))], ["query_id", "v", "cell"]
                    )

        form = T.StructType([queries.schema["query_id"], queries.schema["v"], T.StructField("cell", T.IntegerType())])
        return queries.select("query_id", "v", "need").mapInArrow(run, form)

    def scored(self, visits: DataFrame, k: int) -> DataFrame:
        """query_id, id, score: the ``k`` best points of every block a query looks at."""
        blocks = F.array(*[F.lit(max(1, -(-int(n) // BLOCK))) for n in self.size])
        count = F.element_at(blocks, F.col("cell") + 1)
        none_id, none_query = F.lit(None).cast(self.id_type), F.lit(None).cast(visits.schema["query_id"].dataType)
        points = self.points.select("cell", F.pmod(F.xxhash64("id"), count).cast("int").alias("block"), F.lit(0).alias("side"), "id", none_query.alias("query_id"), "v")
        sent = visits.select("cell", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), F.lit(1).alias("side"), none_id.alias("id"), "query_id", "v")
        both = points.union(sent).repartition("cell", "block").sortWithinPartitions("cell", "block", "side", "id")

        def best(ids: pa.ChunkedArray, held: np.ndarray, asked: pa.RecordBatch) -> pa.RecordBatch:
            score = unit(_table(asked.column(5))) @ held.T
            low = np.partition(score, held.shape[0] - k, axis=1)[:, held.shape[0] - k, None] if held.shape[0] > k else -np.inf
            # All ties at the last place stay until the final ranking by id.
            who, point = np.nonzero(score >= low)
            return pa.RecordBatch.from_arrays(
                [asked.column(4).take(pa.array(who)), pa.array(ids.take(pa.array(point)).to_pylist(), ids.type), pa.array(score[who, point])],
                ["query_id", "id", "score"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, ids, table = None, [], None, None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
                cuts = [*np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]), len(keys)] if len(keys) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key, part = tuple(keys[a, :2]), batch.slice(a, b - a)
                    if key != at:
                        at, held, ids, table = key, [], None, None
                    if keys[a, 2] == 0:
                        held.append(part)
                        continue
                    if held:
                        block, held = pa.Table.from_batches(held), []
                        ids, table = block["id"], unit(_table(block["v"]))
                    if table is not None:
                        for x in range(0, part.num_rows, 256):
                            yield best(ids, table, part.slice(x, 256))

        form = T.StructType([visits.schema["query_id"], T.StructField("id", self.id_type), T.StructField("score", T.DoubleType())])
        return both.mapInArrow(run, form)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def search(index: CellIndex, queries: DataFrame, k: int, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(hits, looks): query_id, id, score, rank of the ``k`` most similar points of every query
    (query_id, v), ties by id; and how many points each query was compared with (query_id, compared)."""
    first = index.visits(queries.withColumn("need", F.lit(None).cast("double")), probes)
    found = stored(_ranked(index.scored(first, k), k), "cells-first")
    last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    need = F.when(F.col("n") == k, F.col("last")).otherwise(F.lit(-2.0))
    left = queries.join(last, "query_id", "left").select("query_id", "v", F.coalesce(need, F.lit(-2.0)).alias("need"))
    second = index.visits(left, probes)
    hits = _ranked(found.drop("rank").union(index.scored(second, k)), k)
    size = F.element_at(F.array(*[F.lit(int(n)) for n in index.size]), F.col("cell") + 1)
    looks = first.union(second).groupBy("query_id").agg(F.sum(size).alias("compared"))
    return hits, looks
