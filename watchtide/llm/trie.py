"""Prefix trie of conversations, summed over subtrees by an Euler tour.

A node is a distinct sequence of first turns; what conversations share is stored once. The
tour enters and leaves every node: two arcs a node, each with the arc after it. Its list
ranking is distributed: arcs are cut into ranges of neighbouring nodes, chains inside a range
shrink to one arc each (numpy, all at once), and the rest is ranked the same way until it
fits one range. Where ranges shrink little, every second arc by a coin takes its
successor in. Going back, each arc's position is its chain's position plus its place in the
chain. Prefix sums of the arcs' weights at these positions, in blocks of positions, give every
subtree's leaves and savings as a difference of two sums.

Hot keys: turns are numbered by a range sort, so one conversation with most turns is many
tasks; a prefix is told by running sums of hashes of (place, turn) in pieces of ``PIECE``
turns; siblings are linked in range-sorted order, so one node with most children is many
tasks, too. The hash of a node's ends is fed from blocks of ids, one block at a time.

Defined cases: rows without conv_id are left out; null turns come first, null role and text
are empty; rows of one turn are ordered by role, then text, repeated ones stay; texts of any
length; an empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchtide.llm.common import stored

PIECE = 4096
#: Arcs ranked together in one task; the end of the contraction.
RANGE = 16384
IDS = 4096
BLOCK = 65536
#: Part and row of ``monotonically_increasing_id``.
PART_BITS = 33


def _numbered(df: DataFrame, ranges: list, order: list, out: str, name: str) -> DataFrame:
    """``df`` with a number that grows in the given order; stored, so that it stays the same.

    Columns with a leading underscore only order the rows.
    """
    dealt = df.repartitionByRange(*ranges).sortWithinPartitions(*order)
    kept = [c for c in df.columns if not c.startswith("_")]
    return stored(dealt.select(*kept, F.monotonically_increasing_id().alias(out)), name)


def in_order(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pieces): conv_id, part, at, t, u, bytes per turn; and per conversation and range
    of the sort its first number and how many turns come before (``first``, ``before``, ``n``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("_turn"),
        text("role").alias("_role"),
        text("text").alias("_text"),
    )
    rows = rows.select(
        "*",
        F.xxhash64("_role", "_text").alias("t"),
        F.xxhash64("_text", "_role", F.lit(1)).alias("u"),
        F.octet_length("_text").cast("long").alias("bytes"),
    )
    turn = F.col("_turn").asc_nulls_first()
    turns = _numbered(
        rows, ["conv_id", turn, F.left("_role", F.lit(32)), F.left("_text", F.lit(32))], ["conv_id", turn, "_role", "_text"], "at", "trie-turns"
    ).withColumn("part", F.shiftright("at", PART_BITS))
    pieces = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, stored(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-pieces")


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as they are: conv_id, pos, t, u, bytes, total; conv_id, total."""
    turns, pieces = in_order(conversations)
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("total"))
    placed = turns.join(pieces.join(convs, "conv_id"), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "t", "u", "bytes", "total"), convs


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """As ``sequences``, but conversation c starts with the first h turns of c - c % group,
    h = crc32(c) % heads, and goes on with its own turns after its first h."""
    turns, pieces = in_order(conversations)
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("own"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn(
        "h", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % heads)
    )
    given = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.join(given, "base", "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    convs = stored(
        convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")),
        "trie-convs",
    )
    placed = turns.join(pieces.join(convs, "conv_id"), ["conv_id", "part"]).withColumn(
        "was", F.col("before") + F.col("at") - F.col("first")
    )
    values = ("t", "u", "bytes", "total")
    own = placed.filter("was >= h").select("conv_id", (F.col("was") - F.col("h") + F.col("lent")).alias("pos"), *values)
    lent = placed.filter((F.col("base") == F.col("conv_id")) & (F.col("was") < heads - 1)).select(
        "base", F.col("was").alias("pos"), "t", "u", "bytes"
    )
    borrowed = convs.filter("lent > 0").join(lent, "base").filter("pos < lent").select("conv_id", "pos", *values)
    return own.union(borrowed), convs.select("conv_id", "total")


def _halves(value: Column, out: tuple[str, str]) -> list[Column]:
    return [value.bitwiseAND(0xFFFFFFFF).alias(out[0]), F.shiftrightunsigned(value, 32).alias(out[1])]


SUMS = ("a", "b", "c", "d")
ROOT = "root"


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, bytes, ends: a row per conversation and turn.

    A prefix is named by sums, over its turns, of hashes of (place, turn): 128 bits, and any
    piece of a conversation adds its part.
    """
    rows = turns.select(
        "conv_id",
        "pos",
        "bytes",
        (F.col("pos") + 1 == F.col("total")).alias("ends"),
        F.floor(F.col("pos") / PIECE).alias("piece"),
        *_halves(F.xxhash64("pos", "t"), ("a", "b")),
        *_halves(F.xxhash64("pos", "u", F.lit(7)), ("c", "d")),
    )
    rows = stored(rows, "trie-rows")
    sums = rows.groupBy("conv_id", "piece").agg(*[F.sum(s).alias(s) for s in SUMS])
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "piece", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in SUMS])
    inside = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(s).over(inside).alias(f"{s}_here") for s in SUMS]).join(sums, ["conv_id", "piece"])
    total = [F.col(f"{s}_before") + F.col(f"{s}_here") for s in SUMS]

    def name(depth: Column, parts: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth, *parts)))

    return rows.select(
        "conv_id",
        (F.col("pos") + 1).alias("depth"),
        name(F.col("pos") + 1, total).alias("node"),
        F.when(F.col("pos") == 0, F.lit(ROOT).cast("binary"))
        .otherwise(name(F.col("pos"), [t - F.col(s) for t, s in zip(total, SUMS, strict=True)]))
        .alias("parent"),
        "bytes",
        "ends",
    )


def _ends(members: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the ids ascending, a comma between.

    A hash has to read its bytes in order; ids come in blocks of one range of ``IDS``, so that
    no list is held whole.
    """
    blocks = members.groupBy("node", F.floor(F.col("conv_id") / IDS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None
        for batch in batches:
            nodes, digests = [], []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != node:
                    if node is not None:
                        nodes.append(node)
                        digests.append(hashed.hexdigest())
                    node, hashed = at, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([hashed.hexdigest()])], ["node", "ends_sha256"])

    blocks = blocks.repartition("node").sortWithinPartitions("node", "block")
    return blocks.mapInArrow(run, "node binary, ends_sha256 string")


def _siblings(nodes: DataFrame) -> DataFrame:
    """id, next_sibling: the node after it with the same parent, in the order of ids."""
    kids = _numbered(nodes.filter("parent_id is not null").select("id", "parent_id"), ["parent_id", "id"], ["parent_id", "id"], "at", "trie-kids")
    kids = kids.withColumn("part", F.shiftright("at", PART_BITS))
    inside = Window.partitionBy("part").orderBy("at")
    kids = kids.select("id", "parent_id", "part", F.lead(F.struct("parent_id", "id")).over(inside).alias("after"))
    # The last of a range looks at the first of the next range; a row per range.
    heads = kids.groupBy("part").agg(F.min(F.struct("parent_id", "id")).alias("head"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("head"))
    kids = kids.join(heads, "part", "left").withColumn("after", F.coalesce("after", "head"))
    return kids.select("id", F.when(F.col("after.parent_id") == F.col("parent_id"), F.col("after.id")).alias("next_sibling"))


def _chains(ids: np.ndarray, after: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: the first arc of every arc's chain, the length before it in the chain; and
    for first arcs what comes after the chain and its length."""
    order = np.argsort(ids)
    ids, after, size = ids[order], after[order], size[order]
    at = np.minimum(np.searchsorted(ids, after), max(len(ids) - 1, 0))
    inside = ids[at] == after
    before = np.arange(len(ids))
    before[at[inside]] = np.flatnonzero(inside)
    place = np.where(before == np.arange(len(ids)), 0, size[before])
    head = before
    while (head[head] != head).any():  # jump twice as far each time
        place = place + place[head]
        head = head[head]
    tail = np.flatnonzero(~inside)
    end, whole = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    end[head[tail]] = after[tail]
    whole[head[tail]] = place[tail] + size[tail]
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    return ids[head][back], place[back], end[back], whole[back]


def _contracted(arcs: DataFrame) -> DataFrame:
    """id, chain, place, after, size of every arc; chains do not leave a range (a partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about RANGE rows of three numbers
        if held:
            ids, after, size = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            chain = _chains(ids, after, size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *chain)], ["id", "chain", "place", "after", "size"])

    return arcs.select("id", "after", "size").mapInArrow(run, "id long, chain long, place long, after long, size long")


def _coupled(arcs: DataFrame, turn: int) -> DataFrame:
    """As ``_contracted``, but every arc that threw heads takes in a successor that threw tails."""
    coin = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2))
    second = arcs.filter(coin == 0).select(F.col("id").alias("mate"), F.col("after").alias("beyond"), F.col("size").alias("more"))
    pairs = arcs.filter(coin == 1).join(second, F.col("after") == F.col("mate"), "left")
    pairs = stored(pairs, "trie-pairs")
    none = F.lit(0).cast("long")
    heads = pairs.select(
        "id", F.col("id").alias("chain"), none.alias("place"), F.coalesce("beyond", "after").alias("after"),
        (F.col("size") + F.coalesce("more", none)).alias("size"),
    )
    taken = pairs.filter("mate is not null")
    mates = taken.select(F.col("mate").alias("id"), F.col("id").alias("chain"), F.col("size").alias("place"), none.alias("after"), none.alias("size"))
    left = arcs.filter(coin == 0).join(taken.select(F.col("mate").alias("id")), "id", "left_anti")
    alone = left.select("id", F.col("id").alias("chain"), none.alias("place"), "after", "size")
    return heads.union(mates).union(alone)


def ranked(arcs: DataFrame, most: int = RANGE) -> DataFrame:
    """(id, place) of every element of a linked list (id, after; -1 at its end), from 0.

    Rounds of contraction until ``most`` elements are left, which one task ranks; then back
    through the rounds. Every round is a table in the shared folder, and together they are
    little larger than the list.
    """
    left, rounds = stored(arcs.select("id", "after", F.lit(1).cast("long").alias("size")), "trie-arcs"), []
    count = left.count()
    while count > most:
        found = stored(_contracted(left.repartitionByRange(-(-count // most), "id")), "trie-chains")
        heads = found.filter("id = chain").select("id", "after", "size")
        rounds.append(found)
        now = heads.count()
        if 4 * now > 3 * count:
            found = stored(_coupled(heads, len(rounds)), "trie-chains")
            heads = found.filter("id = chain").select("id", "after", "size")
            rounds.append(found)
            now = heads.count()
        left, count = heads, now
    places = _contracted(left.coalesce(1)).select("id", "place")
    for found in reversed(rounds):
        start = places.select(F.col("id").alias("chain"), F.col("place").alias("start"))
        places = found.select("id", "chain", "place").join(start, "chain").select("id", (F.col("start") + F.col("place")).alias("place"))
    return places


def _summed(rows: DataFrame, amounts: tuple[str, ...]) -> DataFrame:
    """``rows`` (place, ...) with sums of the amounts before each place, as ``<amount>_before``."""
    rows = rows.withColumn("block", F.floor(F.col("place") / BLOCK))
    sums = rows.groupBy("block").agg(*[F.sum(a).alias(a) for a in amounts])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per BLOCK arcs
    sums = sums.select("block", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"{a}_blocks") for a in amounts])
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(a).over(inside).alias(f"{a}_here") for a in amounts]).join(sums, "block")
    return rows.withColumns({f"{a}_before": F.col(f"{a}_blocks") + F.col(f"{a}_here") - F.col(a) for a in amounts})


def prefix_trie(turns: DataFrame, convs: DataFrame, most: int = RANGE) -> DataFrame:
    """A row per node of the trie of ``turns`` and ``convs``, as ``sequences`` or ``rebuilt`` make them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that storing each node's last text once saves, over the subtree),
    ends_sha256.
    """
    members = stored(_prefixes(turns), "trie-members")
    nodes = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("bytes").alias("bytes"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(ROOT).cast("binary").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"),
    )
    # A node is told by its smallest member and its depth; numbered so, a conversation's nodes are neighbours.
    nodes = _numbered(nodes.union(root), ["conv_id", "depth"], ["conv_id", "depth"], "id", "trie-nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(above, "parent", "left").drop("parent"), "trie-linked")
    kids = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(
        F.min("id").alias("first_child"), F.count(F.lit(1)).alias("n_children")
    )
    nodes = stored(
        nodes.join(kids, "id", "left").join(_siblings(nodes), "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
        "trie-tour",
    )
    # Arc 2 id enters a node, arc 2 id + 1 leaves it.
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    arcs = nodes.select(
        F.explode(
            F.array(
                F.struct(enter("id").alias("id"), F.coalesce(enter("first_child"), leave("id")).alias("after")),
                F.struct(leave("id").alias("id"), F.coalesce(enter("next_sibling"), leave("parent_id"), F.lit(-1)).alias("after")),
            )
        ).alias("arc")
    ).select("arc.id", "arc.after")
    places = ranked(arcs, most).select(F.shiftright("id", 1).alias("id"), (F.col("id") % 2 == 0).alias("enters"), "place")
    weights = places.join(nodes.select("id", "n_children", "n_convs", "bytes"), "id").select(
        "id",
        "place",
        F.when(F.col("enters") & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"),
        F.when(F.col("enters"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).alias("saved"),
    )
    sums = _summed(stored(weights, "trie-places"), ("leaves", "saved"))
    # Sums only grow along the tour: a node's arcs have the least and the largest.
    subtrees = sums.groupBy("id").agg(
        *[(F.max(f"{a}_before") - F.min(f"{a}_before")).alias(out) for a, out in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    )
    nothing = convs.filter("total = 0").select(F.lit(ROOT).cast("binary").alias("node"), "conv_id")
    ends = _ends(members.filter("ends").select("node", "conv_id").union(nothing))
    return (
        nodes.join(subtrees, "id")
        .join(ends, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
