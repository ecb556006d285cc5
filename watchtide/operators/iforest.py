"""Isolation forest: trees are grown one per task, the node table scores all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forest size, sample and depth, and rows needed.
TREES = 50
SAMPLE = 128
DEPTH = 8
MIN_ROWS = 10
#: A tree's candidates: so many times its sample are expected to pass the first cut.
MARGIN = 4
EULER_GAMMA = 0.5772156649

FEATURES = ("rate", "entropy", "unique_sources", "acceleration", "burst_ratio")

NODES = T.StructType(
    [
        T.StructField("tree", T.LongType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("split", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
    ]
)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def _grow(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Split random features at random values until points are alone, equal or deep enough."""
    nodes: list[list] = []
    todo = [(points, 0, -1, 0)]
    while todo:
        pts, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(pts), depth])
        if parent >= 0:
            nodes[parent][side] = me
        if depth >= max_depth or len(pts) <= 1:
            continue
        lo, hi = pts.min(axis=0), pts.max(axis=0)
        usable = [f for f in rng.permutation(pts.shape[1]) if hi[f] > lo[f]]
        if not usable:
            continue
        f = int(usable[0])
        cut = float(rng.uniform(lo[f], hi[f]))
        below = pts[:, f] < cut
        if below.all() or not below.any():
            continue
        nodes[me][1], nodes[me][2] = f, cut
        todo.append((pts[~below], depth + 1, me, 4))
        todo.append((pts[below], depth + 1, me, 3))
    return [tuple(n) for n in nodes]


def drawn(rows: DataFrame, names: Sequence[str], share: Column, trees: int, seed: int) -> DataFrame:
    """A row for every tree a row enters (``tree``), each with probability ``share``."""

    # A lambda may not hold the subquery that counts rows, so it becomes a column first.
    rows = rows.withColumn("_log", F.when(share >= 1, 0.0).otherwise(F.log1p(-share)))

    def skip(salt: Column) -> Column:
        """Trees skipped before the next one entered."""
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), salt, *names), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        steps = F.floor(F.least(F.log(u) / F.col("_log"), F.lit(float(trees))))
        return F.when(F.col("_log") == 0, 0).otherwise(steps).cast("int")

    entered = rows.withColumn("_first", skip(F.lit(-1))).filter(F.col("_first") < trees)

    def onward(acc: Column, i: Column) -> Column:
        step = acc["at"] + 1 + skip(i)
        goes = (acc["at"] < trees) & (step < trees)
        return F.struct(
            F.when(acc["at"] < trees, step).otherwise(acc["at"]).alias("at"),
            F.when(goes, F.concat(acc["trees"], F.array(step))).otherwise(acc["trees"]).alias("trees"),
        )

    start = F.struct(F.col("_first").alias("at"), F.array("_first").alias("trees"))
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), start, onward)
    return entered.withColumn("tree", F.explode(walk["trees"])).drop("_first", "_log")


def train(
    features: DataFrame,
    order: Sequence[str | Column],
    columns: Sequence[str] = FEATURES,
    trees: int = TREES,
    sample: int = SAMPLE,
    depth: int = DEPTH,
    history: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Grow a forest on samples of all vectors; the result is its node table.

    A tree takes ``sample`` rows, drawn by hashes of the order columns, so the same rows give
    the same forest whatever the partitioning. A row's hash says which tree it enters
    first: the number of trees it skips has the geometric distribution of independent draws,
    so nearly all rows of a large table skip all trees and go no further. Of the few
    hundred rows that enter a tree the ``sample`` with the smallest second hash are taken.
    ``features`` is read twice, to count and to draw; store it if it is costly. ``history``
    keeps only the latest rows. Fewer than ten rows give no trees.
    """
    rows = features.select(*[F.col(c).cast("double").alias(c) for c in columns], *order)
    names = rows.columns[len(columns) :]
    if history is not None:
        rows = rows.orderBy(*[F.col(c).desc() for c in names]).limit(history)
    n = rows.agg(F.count(F.lit(1))).scalar()
    share = F.lit(float(MARGIN * sample)) / n
    draws = drawn(rows.filter(n >= MIN_ROWS), names, share, trees, seed).select("tree", *names, F.array(*columns).alias("x"))
    draws = draws.withColumn("h", F.xxhash64(F.lit(seed), F.lit("rank"), "tree", *names))
    first = Window.partitionBy("tree").orderBy("h", "x")
    draws = draws.withColumn("draw", F.row_number().over(first)).filter(F.col("draw") <= sample)
    draws = draws.select(F.col("tree").cast("long").alias("tree"), "x")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pts = np.array(sorted(map(tuple, pdf["x"])), dtype=float)
        grown = _grow(pts, np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(
            grown, columns=["node", "feature", "split", "left", "right", "size", "depth"]
        )
        out.insert(0, "tree", tree)
        return out

    return draws.groupBy("tree").applyInPandas(build, NODES)


def score(
    df: DataFrame,
    model: DataFrame,
    columns: Sequence[str] = FEATURES,
    sample: int = SAMPLE,
    name: str = "iforest_score",
) -> DataFrame:
    """Anomaly score in [0, 1] of each row.

    The node table has at most trees x 2^(depth+1) rows whatever the data, so it is
    fetched once and sent to the tasks that score.
    """
    nodes = model.toPandas().sort_values(["tree", "node"])
    if nodes.empty:
        return df.withColumn(name, F.lit(0.0))
    forest = []
    for _, t in nodes.groupby("tree"):
        leaf = t["depth"].to_numpy() + expected_path(t["size"].to_numpy())
        forest.append(
            tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right")) + (leaf,)
        )
    steps = int(nodes["depth"].max())
    norm = float(expected_path(np.array([sample]))[0])

    @F.pandas_udf(T.DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, split, left, right, leaf in forest:
            at = np.zeros(len(x), dtype=int)
            for _ in range(steps):
                f = feature[at]
                inner = f >= 0
                below = x[rows, np.maximum(f, 0)] < split[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += leaf[at]
        value = np.exp2(-(total / len(forest)) / norm)
        return pd.Series(np.clip(value, 0.0, 1.0))

    return df.withColumn(name, run(*columns))
