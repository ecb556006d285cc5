"""Hard-negative mining over an inverted multi-index.

A vector is cut into two halves, each with a codebook of its own (k-means on at most
``SAMPLE`` rows, chosen by a hash of the id); the pair of its nearest codes is its cell. Every
row is in the index. For an anchor the inner product with any half of code c is at most
<half anchor, c> + |half anchor| * radius(c), with the radius over all rows, so a cell's bound is
the sum of two half bounds, and a heap over the two sorted lists of half bounds visits cells
from the largest sum down (the multi-sequence algorithm).

A search has two rounds. The first visits the ``FIRST`` best cells. The windows it fills give a score that
anything still missing has to reach; the second visits the cells after those, down to
the first whose bound is below that, which certifies the windows: nothing outside can enter
them. Results are exact. First the best rows of an anchor's own label are searched, then
for each of them the best rows of other labels within its window of scores.

An anchor travels once to each first half code with a cell to visit, not to every cell, and
meets the rows there in Arrow batches. A code with many rows is cut into blocks of about
``ROWS``; equal vectors of one label count with their smallest ids only (a window holds
no more of them), so many copies of a vector are no hot cell.

Defined cases: rows with a null id, label, vector or component, or a component that is not
finite, take no part; vectors that are shorter than the longest count as filled up with
zeros; whole-number components beyond +-2^28 count as that; repeated rows count once, and rows that
share an anchor's id are not its positives (the one of the smallest label and vector is the anchor); ties go to the smaller id; an empty table, or
one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchtide.llm.common import stored

CODES = 32
SAMPLE = 20000
FIRST = 64
ROWS = 4096
#: Whole numbers above this are cut, so that scores stay within 64 bits.
LARGEST = 1 << 28


def whole_numbers(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, v (floor(scale * x) of every component) of the rows that take part."""
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x")
    )
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(
        F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    limit = float(LARGEST)
    cut = lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(limit)), F.lit(-limit)))
    return rows.select("vec_id", "label", F.transform("x", cut).alias("v"))


def _packed(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Vectors as bytes of ``width`` numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            table = np.zeros((len(sizes), width), dtype=kind)
            table[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            raw = [row.tobytes() for row in table]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "v"])

    return rows.mapInArrow(run, "vec_id long, label long, v binary")


def _numbers(raw: list[bytes], width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), width)


class Codebooks:
    """Codes of both halves, and what bounds inner products with what they stand for."""

    def __init__(self, sample: np.ndarray, codes: int = CODES, seed: int = 7):
        self.half = (sample.shape[1] + 1) // 2
        self.centers = [self._fit(x.astype(np.float64), codes, seed + k) for k, x in enumerate(self.halves(sample))]

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.half], rows[:, self.half :]

    @staticmethod
    def _fit(rows: np.ndarray, codes: int, seed: int) -> np.ndarray:
        """k-means, ten steps from distinct rows."""
        rng = np.random.default_rng(seed)
        distinct = np.unique(rows, axis=0)
        centers = distinct[rng.permutation(len(distinct))[:codes]].copy()
        for _ in range(10):
            near = Codebooks._nearest(rows, centers)[0]
            sums = np.zeros_like(centers)
            np.add.at(sums, near, rows)
            n = np.bincount(near, minlength=len(centers))
            centers[n > 0] = sums[n > 0] / n[n > 0, None]
        return centers

    @staticmethod
    def _nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(axis=1)[None, :]
        near = far.argmin(axis=1)
        return near, np.sqrt(((rows - centers[near]) ** 2).sum(axis=1))

    def place(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(code, distance) of both halves."""
        return [self._nearest(x.astype(np.float64), c) for x, c in zip(self.halves(rows), self.centers, strict=True)]

    def bounds(self, rows: np.ndarray, radii: list[np.ndarray]) -> list[np.ndarray]:
        """Per half a table (row, code) of the largest inner product possible."""
        found = []
        for x, c, r in zip(self.halves(rows.astype(np.float64)), self.centers, radii, strict=True):
            size = np.sqrt((x**2).sum(axis=1))[:, None]
            top = x @ c.T + size * r[None, :]
            # Room for rounding: the bound must hold for whole numbers.
            found.append(top + 1e-6 + 1e-9 * size * (r + np.sqrt((c**2).sum(axis=1)))[None, :])
        return found


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all cells, from the largest sum of half bounds down."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        low, p, q = heapq.heappop(heap)
        yield -low, a[p], b[q]
        # A cell is pushed by the one before it in its row, the first of a row by the row above.
        if q + 1 < len(y):
            heapq.heappush(heap, (-(x[p] + y[q + 1]), p, q + 1))
        if q == 0 and p + 1 < len(x):
            heapq.heappush(heap, (-(x[p + 1] + y[0]), p + 1, 0))


class Index:
    """Rows by cell: grp (first half code and block), cell (second half code), vec_id, label, v."""

    def __init__(self, rows: DataFrame, width: int, kind: str, codes: int, sample: int):
        self.kind, self.numbers = kind, partial(_numbers, width=width, kind=kind)
        chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(sample).select("v").toArrow()
        self.books = Codebooks(self.numbers(chosen["v"].to_pylist()), codes)
        books, numbers = self.books, self.numbers

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    (i, r), (j, s) = books.place(numbers(batch.column(2).to_pylist()))
                    more = [pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), r, s)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["vec_id", "label", "v", "i", "j", "r", "s"])

        placed = stored(
            rows.mapInArrow(place, "vec_id long, label long, v binary, i int, j int, r double, s double"), "negatives-placed"
        )
        cells = placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max("s").alias("s"))
        cells = cells.toArrow().to_pydict()  # codes * codes rows at most
        i, j, n = (np.array(cells[c]) for c in "ijn")
        self.radii = [np.zeros(len(c)) for c in self.books.centers]
        for at, far, radius in ((i, cells["r"], self.radii[0]), (j, cells["s"], self.radii[1])):
            np.maximum.at(radius, at, np.array(far))
        self.there = np.zeros([len(c) for c in self.books.centers], dtype=bool)
        self.there[i, j] = True
        self.blocks = np.maximum(1, -(-np.bincount(i, n, len(self.radii[0])).astype(np.int64) // ROWS))
        # Blocks by a hash of the id, so that any run of ids is spread.
        many = F.array(*[F.lit(int(b)) for b in self.blocks])
        self.starts = np.concatenate([[0], np.cumsum(self.blocks)[:-1]])
        start = F.array(*[F.lit(int(s)) for s in self.starts])
        code = F.col("i") + 1
        grp = F.element_at(start, code) + F.pmod(F.xxhash64("vec_id"), F.element_at(many, code)).cast("int")
        self.rows = stored(placed.select(grp.cast("int").alias("grp"), F.col("j").alias("cell"), "vec_id", "label", "v"), "negatives-index")

    def visits(self, anchors: DataFrame, first: int) -> DataFrame:
        """Per anchor and block of rows: which second codes to visit (a byte each).

        ``anchors``: vec_id, label, v, ask (scores the windows are about), need. Where ``need`` is null, the
        first cells; else the cells after those with a bound of ``need`` or more.
        """
        books, numbers, radii, there, blocks, starts = self.books, self.numbers, self.radii, self.there, self.blocks, self.starts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    needs = batch.column(4).to_pylist()
                    tops = books.bounds(numbers(batch.column(2).to_pylist()), radii)
                    owner, grp, cells = [], [], []
                    for k, need in enumerate(needs):
                        chosen, seen = np.zeros(there.shape, dtype=np.uint8), 0
                        for bound, i, j in multi_sequence(tops[0][k], tops[1][k]):
                            if (seen >= first) if need is None else (bound < need):
                                break
                            if there[i, j]:
                                seen += 1
                                if need is None or seen > first:
                                    chosen[i, j] = 1
                        for i in np.flatnonzero(chosen.any(axis=1)):
                            for b in range(blocks[i]):
                                owner.append(k)
                                grp.append(starts[i] + b)
                                cells.append(chosen[i].tobytes())
                    took = batch.take(pa.array(owner, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grp, pa.int32()), *took.columns[:4], pa.array(cells, pa.binary())],
                        ["grp", "vec_id", "label", "v", "ask", "cells"],
                    )

        columns = anchors.select("vec_id", "label", "v", "ask", "need")
        return columns.mapInArrow(run, "grp int, vec_id long, label long, v binary, ask array<long>, cells binary")

    def scored(self, visits: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """anchor_id, turn, vec_id, score: per anchor and window the ``k`` best rows of each block.

        An anchor that asks about no scores looks for rows of its own label (turn 0); else, for
        each score asked about, for rows of other labels within low/high of it.
        """
        numbers, kind = self.numbers, self.kind
        rows = self.rows.select(
            "grp", F.lit(0).alias("side"), "cell", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("ask"), F.lit(None).cast("binary").alias("cells")
        )
        sent = visits.select("grp", F.lit(1).alias("side"), F.lit(0).alias("cell"), "vec_id", "label", "v", "ask", "cells")
        both = rows.union(sent).repartition("grp").sortWithinPartitions("grp", "side", "cell", "vec_id")

        def best(block: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
            held = _exact(numbers(block["v"].to_pylist()), kind)
            ids, labels, cell = (block[c].to_numpy() for c in ("vec_id", "label", "cell"))
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            query = _exact(numbers(batch.column(5).to_pylist()), kind)
            own, label = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            asked = batch.column(6).to_pylist()
            turns = max(1, max(map(len, asked)))
            ask = np.array([x + [-1] * (turns - len(x)) for x in asked], dtype=np.int64) if any(asked) else None
            go = np.stack([np.frombuffer(x, np.uint8) for x in batch.column(7).to_pylist()]).astype(bool)
            got: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                who = np.flatnonzero(go[:, cell[a]])
                if not len(who):
                    continue
                score = (query[who] @ held[a:b].T).astype(np.int64)
                same = label[who, None] == labels[None, a:b]
                for turn in range(turns):
                    if ask is None:
                        fits = same & (own[who, None] != ids[None, a:b])
                    else:
                        top = ask[who, turn][:, None]
                        fits = ~same & (top >= 0) & (score <= top) & (high * score >= low * top)
                    if b - a > k:  # not below the k-th best of this cell
                        shown = np.where(fits, score, _NEVER)
                        fits &= score >= np.partition(shown, b - a - k, axis=1)[:, b - a - k, None]
                    x, y = np.nonzero(fits)
                    for out, values in zip(got, (who[x], np.full(len(x), turn), ids[a + y], score[x, y]), strict=True):
                        out.append(values)
            who, turn, found, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
            order = np.lexsort((found, -score, turn, who))
            who, turn, found, score = (x[order] for x in (who, turn, found, score))
            new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (turn[1:] != turn[:-1])])) if len(who) else np.zeros(0, np.int64)
            rank = np.arange(len(who)) - np.repeat(new, np.diff([*new, len(who)]))
            who, turn, found, score = (x[rank < k] for x in (who, turn, found, score))
            return pa.RecordBatch.from_arrays(
                [pa.array(own[who]), pa.array(turn, pa.int32()), pa.array(found), pa.array(score)], ["anchor_id", "turn", "vec_id", "score"]
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []  # the rows of one block, about ROWS
            block, at = None, None
            for whole in batches:
                keys = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    grp, side = divmod(int(keys[a]), 2)
                    part = whole.slice(a, b - a)
                    if grp != at:
                        at, held, block = grp, [], None
                    if side == 0:
                        held.append(part)
                        continue
                    if held:
                        block, held = pa.Table.from_batches(held).combine_chunks(), []
                    if block is not None:
                        for x in range(0, part.num_rows, 256):
                            yield best(block, part.slice(x, 256))

        return both.mapInArrow(run, "anchor_id long, turn int, vec_id long, score long")


_NEVER = np.iinfo(np.int64).min


def _exact(rows: np.ndarray, kind: str) -> np.ndarray:
    """Numbers whose inner products are exact: floats while all sums stay below 2^53."""
    return rows.astype(np.float64 if kind == "<i2" else np.int64)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every window."""
    best = Window.partitionBy("anchor_id", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(index: Index, anchors: DataFrame, k: int, first: int, low: int, high: int) -> DataFrame:
    """anchor_id, turn, vec_id, score, rank of the certified windows. ``anchors``: vec_id, label, v, ask."""
    start = anchors.withColumn("need", F.lit(None).cast("double"))
    found = stored(_first(index.scored(index.visits(start, first), k, low, high), k), "negatives-first")
    # What a missing row of a window must reach: the score of its last row, or the window's own end.
    full = found.groupBy("anchor_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    full = full.filter(F.col("n") == k).select(F.col("anchor_id").alias("vec_id"), "turn", F.col("last").cast("double"))
    windows = anchors.select("vec_id", F.posexplode_outer("ask").alias("turn", "top"))
    least = F.when(F.col("top") < 0, float("inf")).otherwise(F.col("top") * float(low) / float(high) - 1e-3)  # nothing fits below 0
    windows = windows.select("vec_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce(least, F.lit(float("-inf"))).alias("end"))
    need = windows.join(full, ["vec_id", "turn"], "left").groupBy("vec_id").agg(F.min(F.greatest("end", F.coalesce("last", F.lit(float("-inf"))))).alias("need"))
    rest = index.scored(index.visits(anchors.join(need, "vec_id"), first), k, low, high)
    return stored(_first(found.drop("rank").union(rest).distinct(), k), "negatives-found")


def hard_negatives(
    embeddings: DataFrame,
    anchors_at: int = 100,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    codes: int = CODES,
    first: int = FIRST,
    sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``anchors_at``; a positive is one of the first ``k``
    other rows of its label; negatives of it are the first ``k`` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score.
    """
    rows = stored(whole_numbers(embeddings, id_col, vector_col, label_col, scale), "negatives-rows")
    shape = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, largest = max(2, shape[0] or 0), shape[1] or 0
    kind = "<i2" if largest < 1 << 15 and width < 1 << 22 else "<i4"
    rows = _packed(rows, width, kind)
    # Of equal vectors of a label a window holds the k smallest ids, and one may be the anchor.
    same = Window.partitionBy("v", "label").orderBy("vec_id")
    kept = rows.withColumn("_turn", F.dense_rank().over(same)).filter(F.col("_turn") <= k + 1).drop("_turn").dropDuplicates(["v", "label", "vec_id"])
    kept = stored(kept, "negatives-kept")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if kept.isEmpty():
        return embeddings.sparkSession.createDataFrame([], out)
    anchors = rows.filter(F.col("vec_id") % anchors_at == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = stored(anchors.select("vec_id", "a.label", "a.v", F.array().cast("array<long>").alias("ask")), "negatives-anchors")
    index = Index(kept, width, kind, codes, sample)
    positives = _search(index, anchors, k, first, low, high)
    asks = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asks = anchors.drop("ask").join(asks, "vec_id").withColumn("ask", F.transform("p", lambda p: p["score"])).drop("p")
    negatives = _search(index, stored(asks, "negatives-asks"), k, first, low, high)
    given = positives.select(
        "anchor_id", (F.col("rank") - 1).alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.join(given, ["anchor_id", "turn"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
