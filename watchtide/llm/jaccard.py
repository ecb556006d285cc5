"""N-gram Jaccard join over a count-vector R-tree.

A text is the set of its word shingles. Shingle hashes fall into ``GROUPS`` groups; the
counts per group are the text's point. The overlap of two sets is at most the sum of the
smaller coordinates, and of a set with anything inside a box at most the sum of the smaller
of its coordinates and the box's upper corner. With sizes a and b, similarity s needs an
overlap of s / (1 + s) * (a + b), so the tree discards boxes and points that cannot reach
it. Pairs of points are bounded once more by finer groups, about as many as a set has
shingles (texts that share a passage have many coarse counts in common, but few fine
ones), and the pairs left are verified on the full sets.

Spreading the tree: texts with equal sets are one point. Every point goes to ``KEYS``
buckets named by the smallest shingle hash under as many permutations. Two sets of
similarity 0.75 share no bucket with probability 0.25 ** 24, about 4e-15, less than a
collision of hashes, so no link is lost in practice. Each bucket has a tree of its own.

Large groups of copies cost their size, not its square: first every point is compared with
its buckets' smallest ids, those it meets in ``LIKELY`` buckets or more, and verified links become components. Then only buckets that
hold several components are searched, and only for pairs between different components. Such
a pair meets in ``SHARED`` buckets or more (less often with probability 9e-12 at 0.75), so every point
leaves out its ``SHARED`` - 1 largest ones: in one order of all buckets, two sets with so many in
common still have one (prefix filter). That leaves the buckets of frequent passages nearly empty. The
components are those of all links. A bucket above ``SPLIT`` points is cut into one for each
other key of its points; one still above is dealt in blocks of points, every two blocks
together, so that no task gets many more than twice ``SPLIT``. Nothing is capped and no list of pairs within a group is made.

Defined cases: null or wordless texts have an empty set and are linked with nothing; with
fewer words than a shingle the whole text is one; rows without an id are in the result as
their own, unlinked; rows sharing an id are one node; repeated rows give repeated rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchtide.llm.common import components, stored
from watchtide.llm.shingles import mixed, runs, shingle_sets

WIDTH = 5
PERCENT = 75
GROUPS = 128
#: Finer groups of a set up to this size; twice as many for each doubling.
FINE = 512
KEYS = 24
#: Buckets two linked points share at least, and those that make a first comparison worth while.
SHARED, LIKELY = 3, 6
SPLIT = 20000
LEAF = 32
BITMAPS = 256


def _points(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, keys, counts per row.

    ``counts``: those of the fine groups (see ``_packed``).
    """
    salts = mixed(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch.column(1)):
                sizes, digests, keys, counts = [], [], [], []
                for shingles in shingle_sets(texts, width):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        digests.append(None)
                        keys.append(None)
                        counts.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    low = np.array([((shingles ^ s) * (s | np.uint64(1))).min() for s in salts])
                    low = mixed(low + salts)
                    keys.append(low.view(np.int64))
                    bits = max(FINE, len(shingles) - 1).bit_length() - (len(shingles) <= FINE)
                    point = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    counts.append(_packed(point))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(counts, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "keys", "counts"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, n_shingles long, digest binary, keys array<long>, counts binary"
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the whole set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"node {kind}, shingles array<long>")


def _packed(point: np.ndarray) -> bytes:
    """A byte for the width of a number, then the numbers; two of them share a byte if all are below 16."""
    most = point.max()
    if most < 16:
        return b"\0" + (point[::2] | point[1::2] << 4).astype(np.uint8).tobytes()
    width = 1 if most < 256 else 2 if most < 65536 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def _fine(raw: bytes) -> np.ndarray:
    if raw[0]:
        return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1)
    pairs = np.frombuffer(raw, dtype=np.uint8, offset=1)
    out = np.empty(2 * len(pairs), dtype=np.uint8)
    out[::2], out[1::2] = pairs & 15, pairs >> 4
    return out


def _vector(raw: bytes) -> np.ndarray:
    """Fine counts summed to the coarse groups of the tree."""
    return _fine(raw).reshape(GROUPS, -1).sum(axis=1, dtype=np.int64).astype(np.int32)


class Fine:
    """Fine counts of many points, those of one width as one table."""

    def __init__(self, raws: list[bytes]):
        rows = [_fine(raw) for raw in raws]
        self.groups = np.array([len(r) for r in rows], dtype=np.int64)
        self.size = np.array([r.sum(dtype=np.int64) for r in rows], dtype=np.int64)
        self.place = np.zeros(len(rows), dtype=np.int64)
        self.tables = {}
        for g in np.unique(self.groups).tolist():
            mine = np.flatnonzero(self.groups == g)
            self.place[mine] = np.arange(len(mine))
            self.tables[g] = np.stack([rows[k] for k in mine])

    def possible(self, i: np.ndarray, other: Fine, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the summed minima of points ``i`` and the other's points ``j`` allow the similarity."""
        good = np.zeros(len(i), dtype=bool)
        for g in np.unique(self.groups[i]).tolist():
            for h in np.unique(other.groups[j]).tolist():
                at = np.flatnonzero((self.groups[i] == g) & (other.groups[j] == h))
                for k in range(0, len(at), 1 << max(0, 22 - max(g, h).bit_length())):
                    part = at[k : k + (1 << max(0, 22 - max(g, h).bit_length()))]
                    x, y = self.tables[g][self.place[i[part]]], other.tables[h][other.place[j[part]]]
                    x, y = (t if t.shape[1] == min(g, h) else t.reshape(len(part), min(g, h), -1).sum(axis=2) for t in (x, y))
                    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                    good[part] = (100 + percent) * most >= percent * (self.size[i[part]] + other.size[j[part]])
        return good


class Tree:
    """Neighbouring points packed into boxes of LEAF, boxes into boxes, up to one root level.

    With ``groups``, pairs of boxes that hold one and the same group only are not looked at.
    """

    def __init__(self, points: np.ndarray, groups: np.ndarray | None = None):
        self.size = points.sum(axis=1)
        groups = np.arange(len(points)) if groups is None else np.unique(groups, return_inverse=True)[1]
        # A group that fills boxes has boxes of its own.
        own = np.where(np.bincount(groups)[groups] >= 2 * LEAF, groups, -1)
        by_own = np.argsort(own, kind="stable")
        parts = np.split(by_own, np.flatnonzero(np.diff(own[by_own])) + 1)
        self.order = np.concatenate([_neighbours(points, self.size, part) for part in parts])
        self.points, self.size = points[self.order], self.size[self.order]
        self.levels = []
        high, low, least, most = self.points, self.size, groups[self.order], groups[self.order]
        while True:
            at = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low, at)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, low, np.where(least == most, least, -1)))
            if len(high) <= LEAF:
                break

    def join(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), as given positions, that the bound does not rule out."""

        def possible(high_a, low_a, high_b, low_b) -> np.ndarray:
            most = np.minimum(high_a, high_b).sum(axis=1, dtype=np.int64)
            return (100 + percent) * most >= percent * (low_a + low_b)

        a, b = np.triu_indices(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, group = self.levels[depth]
            several = (group[a] != group[b]) | (group[a] < 0)
            a, b = a[several], b[several]
            keep = np.concatenate(
                [possible(high[x], low[x], high[y], low[y]) for x, y in _blocks(a, b)] or [np.zeros(0, bool)]
            )
            a, b = a[keep], b[keep]
            if depth:
                a, b = self._children(a, b, len(self.levels[depth - 1][0]))
        # Leaf pairs, some at a time, to pairs of points.
        for x, y in _blocks(a, b, 512):
            i, j = self._children(x, y, len(self.points))
            ok = i < j
            i, j = i[ok], j[ok]
            for p, q in _blocks(i, j):
                good = possible(self.points[p], self.size[p], self.points[q], self.size[q])
                yield self.order[p[good]], self.order[q[good]]

    @staticmethod
    def _children(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(LEAF)
        i = np.repeat((a[:, None] * LEAF + step), LEAF, axis=1).ravel()
        j = np.tile((b[:, None] * LEAF + step), (1, LEAF)).ravel()
        ok = (i < count) & (j < count) & (i <= j)
        return i[ok], j[ok]


def _neighbours(points: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` in an order that keeps near points together: halved again and again by the size
    or coordinate that differs most."""
    out, open_ = [], [rows]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        all_ = np.column_stack([size[rows], points[rows]])
        half = LEAF * (-(-len(rows) // LEAF) // 2)
        order = np.argsort(all_[:, all_.var(axis=0).argmax()], kind="stable")
        open_ += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out)


def _blocks(a: np.ndarray, b: np.ndarray, size: int = 32768) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(a), size):
        yield a[at : at + size], b[at : at + size]


def _search(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of different components that a bucket's tree cannot rule out.

    ``buckets``: key, node, component, counts; a task gets whole keys, sorted by key. A pair may
    be told by several buckets.
    """

    def pairs_of(table: pa.Table) -> Iterator[tuple[list, list]]:
        keys = table["key"].to_numpy()
        nodes, groups = table["node"].to_numpy(), table["component"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for start, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if end - start < 2:
                continue
            if (groups[start:end] == groups[start]).all():
                continue
            raws = table["counts"].slice(start, end - start).to_pylist()
            fine = Fine(raws)
            for i, j in Tree(np.stack([_vector(raw) for raw in raws]), groups[start:end]).join(percent):
                i, j = start + i, start + j
                ok = groups[i] != groups[j]
                i, j = i[ok], j[ok]
                ok = fine.possible(i - start, fine, j - start, percent)
                i, j = i[ok], j[ok]
                if len(i):
                    yield np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(upto: int | None):
            nonlocal held
            table = pa.Table.from_batches(held)
            now, held = table.slice(0, upto), table.slice(upto).to_batches() if upto is not None else []
            for a, b in pairs_of(now.combine_chunks()) if len(now) else ():
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("node").type
            last = batch.column(0)[batch.num_rows - 1]
            same = batch.column(0)[0] == last and held and held[0].column(0)[0] == last
            held.append(batch)
            if not same:
                keys = pa.Table.from_batches(held)["key"].to_numpy()
                yield from flush(int(np.searchsorted(keys, keys[-1])))
        if held:
            yield from flush(None)

    kind = buckets.schema["node"].dataType.simpleString()
    return buckets.select("key", "node", "component", "counts").mapInArrow(run, f"a {kind}, b {kind}")


def _maybe(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without most rows that are not in ``nodes``, so that their texts are not shuffled.

    A bit per hash of an id: BITMAPS bitmaps of 32,768 bits, 1 MB however large ``nodes`` is,
    so it is broadcast. It lets every row of ``nodes`` through, and the semi-join decides.
    """
    spread = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(BITMAPS * 32768))
    bits = nodes.select(F.floor(spread() / 32768).cast("int").alias("_map"), F.pmod(spread(), F.lit(32768)).alias("_bit"))
    maps = bits.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(pmod(_h, 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = docs.withColumn("_h", spread()).withColumn("_map", F.floor(F.col("_h") / 32768).cast("int"))
    hit = F.expr("shiftright(_byte, cast(pmod(_h, 8) as int)) & 1") == 1
    return rows.join(F.broadcast(maps), "_map").withColumn("_byte", byte).filter(hit).select("doc_id", "text")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = stored(_sets(_maybe(docs, nodes).join(nodes, "doc_id", "left_semi").select("doc_id", "text"), width), "jaccard-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), (F.size("s") + F.size("t")).alias("n"))
    return both.filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("n") - F.col("i"))).select("a", "b")


def _several(rows: DataFrame) -> DataFrame:
    """(key, n) of the buckets that hold several components; ``rows`` has key, component."""
    sizes = rows.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("n"))
    return sizes.filter("c <> d").select("key", "n")


def _split(rows: DataFrame, most: int) -> DataFrame:
    """(node, component, counts, key): rows of buckets that are too large, in smaller ones.

    ``rows``: node, component, counts, turn, key, keys. The key a bucket is named by does not
    divide it, so it is no second key. Two blocks of a bucket above ``most`` meet in a bucket.
    """
    others = F.filter("keys", lambda k, i: i != F.col("turn"))
    second = rows.select(
        "node", "component", "counts", F.explode(F.transform(others, lambda k: F.xxhash64("key", k))).alias("key")
    )
    second = stored(second, "jaccard-split")
    second = second.join(_several(second), "key").withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    second = second.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    second = second.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return second.select(
        "node", "component", "counts", F.when(F.col("blocks") > 1, pair).otherwise(F.col("key")).alias("key")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    points = stored(_points(docs, width), "jaccard-points")
    members = points.select("doc_id", "n_shingles", "digest")
    # Texts with equal sets are one node, named by the smallest id.
    classes = points.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("node")
    )
    classes = stored(classes, "jaccard-classes")
    nodes = stored(
        points.join(classes.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"]).select(
            F.col("doc_id").alias("node"), "n_shingles", "keys", "counts"
        ),
        "jaccard-nodes",
    )
    rows = nodes.select("node", F.posexplode("keys").alias("turn", "key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(hubs.select("key", "hub"), "key").filter("node <> hub").groupBy("hub", "node").agg(F.count(F.lit(1)).alias("n"))
    first = met.filter(F.col("n") >= LIKELY)
    # The bound on single pairs, by group counts.
    first = _bounded(first.select(F.col("hub").alias("a"), F.col("node").alias("b")), nodes, percent)
    first = stored(_verified(stored(first, "jaccard-first"), docs, width, percent), "jaccard-links")
    found = components(first, "jaccard-components")
    label = stored(
        nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")),
        "jaccard-labels",
    )
    rows = rows.join(label, "node")
    largest = Window.partitionBy("node").orderBy(F.desc("n"), "key")
    kept = rows.join(stored(_several(rows), "jaccard-buckets"), "key").withColumn("rank", F.row_number().over(largest))
    kept = stored(kept.filter(F.col("rank") >= SHARED).select("node", "turn", "key", "component"), "jaccard-kept")
    mixed_buckets = stored(_several(kept), "jaccard-mixed")
    columns = ("node", "component", "counts", "key")
    small = mixed_buckets.filter(F.col("n") <= SPLIT)
    open_rows = kept.join(small.select("key"), "key").join(nodes, "node").select(*columns)
    large = mixed_buckets.filter(F.col("n") > SPLIT)
    if not large.isEmpty():
        open_rows = open_rows.union(_split(kept.join(large.select("key"), "key").join(nodes, "node").select(*columns, "turn", "keys"), SPLIT))
    candidates = _search(open_rows.repartition("key").sortWithinPartitions("key"), percent).distinct()
    second = stored(_verified(stored(candidates, "jaccard-second"), docs, width, percent), "jaccard-links")
    final = components(first.union(second), "jaccard-components")
    return (
        members.join(classes, "digest", "left")
        .join(final, "node", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")
        )
    )


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose summed minima of fine counts allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                keep = Fine(batch.column(2).to_pylist()).possible(at, Fine(batch.column(3).to_pylist()), at, percent)
                yield batch.select([0, 1]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    sized = lambda side: nodes.select(
        F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("counts").alias(f"c_{side}")
    )
    both = pairs.join(sized("a"), "a").join(sized("b"), "b")
    near = (F.lit(100) * F.least("n_a", "n_b")) >= F.lit(percent) * F.greatest("n_a", "n_b")
    return both.filter(near).select("a", "b", "c_a", "c_b").mapInArrow(run, f"a {kind}, b {kind}")
