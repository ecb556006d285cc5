"""Passages that repeat across texts, by sorted suffixes and induced order.

A byte goes when a 50-byte string that covers it also starts in a text with a smaller id.

1. Of every 50-byte string the 20 bytes with the smallest hash are its anchor; equal strings
   have equal anchors at equal places. Anchors that only one text has cannot lie in a
   repeated string and are left out: packed hashes meet in partitions and only those
   of shared ones go back to their texts.
2. The suffixes that begin at shared anchors are sorted outside of memory (Spark's spilling
   sort by anchor, then a sort of each anchor's suffixes). The order of the suffixes that
   begin d bytes before is induced, one byte at a time, by a stable pass over the order of
   those that begin d - 1 bytes before; common-prefix lengths are carried along, so strings
   of 50 equal bytes are neighbours at every d and their smallest id is known.
3. The starts of repeated strings go back to their texts, which are cut once.

The induction follows a fixed number of steps (an anchor is at most 30 bytes into its
string), where full recursive induction would order all suffixes of all texts, most of which
repeat nowhere. Equal texts are handled first: all but the smallest id lose every byte.

Defined cases: null text is empty; texts below 50 bytes lose nothing; different texts may
share an id: they are not earlier than each other, and each is cut at its own places (the
smallest digest of an id is its text 0, any other is numbered by its hash); rows without an id are earlier than none and lose nothing;
repeated rows get equal results; an empty table gives an empty result; other columns are
not read; matches never cross texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import shared_dir, stored
from watchtide.llm.shingles import mixed, runs

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
#: Parts of the hash space, at least; a power of two, and no fewer than shuffle partitions.
PARTS = 256
#: Bytes kept on each side of an anchor's beginning.
LEFT, RIGHT = SPAN - 1, LENGTH


def _word(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8 bytes from every position on, as numbers."""
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out |= data[at + i : at + i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first, last): every anchor and the starts of the strings it stands for."""
    n = len(data) - GRAM + 1
    hashes = _word(data, 0, n)
    for at in (8, GRAM - 8):
        hashes = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) ^ _word(data, at, n))
    value, place = hashes, np.arange(n)
    width = 1
    while 2 * width <= SPAN:
        value, place = _smaller(value, place, width)
        width *= 2
    if width < SPAN:
        value, place = _smaller(value, place, SPAN - width)
    change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[change]
    return at, hashes[at], change, np.concatenate([change[1:], [len(place)]]) - 1


def _smaller(value: np.ndarray, place: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum with the window ``shift`` further; the leftmost of equal ones."""
    later = value[shift:] < value[:-shift]
    return np.where(later, value[shift:], value[:-shift]), np.where(later, place[shift:], place[:-shift])


def _bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.frombuffer(text.as_py() or b"", dtype=np.uint8)


def _packed(docs: DataFrame, parts: int) -> DataFrame:
    """(part, ids, block): 4 bytes of every anchor's hash, by part of the hashes; a text tells
    a hash once. A block is how many hashes each id has, then the hashes, id by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch.column(1)):
                hashes, owner = [], []
                for i, data in enumerate(_bytes(texts)):
                    if len(data) >= LENGTH:
                        hashes.append(np.unique(anchors(data)[1]))
                        owner.append(np.full(len(hashes[-1]), i, dtype=np.uint32))
                if not hashes:
                    continue
                h, o = np.concatenate(hashes), np.concatenate(owner)
                part = (h >> np.uint64(65 - parts.bit_length())).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                ids = batch.column(0).slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
                out = ([], [], [])
                for p in range(parts):
                    mine = order[ends[p] : ends[p + 1]]
                    if len(mine):
                        present, each = np.unique(o[mine], return_counts=True)
                        block = np.concatenate([each.astype(np.uint32), (h[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32)])
                        out[0].append(p)
                        out[1].append(ids[present].tobytes())
                        out[2].append(block.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["part", "ids", "block"]
                )

    return docs.mapInArrow(run, "part int, ids binary, block binary")


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """(doc_id, hashes): 4 bytes of the hashes of anchors that two texts have; a task gets whole parts."""

    def found(rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        ids, hashes = [], []
        for _, own, block in rows:
            own, block = np.frombuffer(own, dtype=np.int64), np.frombuffer(block, dtype=np.uint32)
            ids.append(np.repeat(own, block[: len(own)]))
            hashes.append(block[len(own) :])
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        ids, hashes = ids[order], hashes[order]
        cut = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        several = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
        keep = np.repeat(several, np.diff([*cut, len(ids)]))
        ids, hashes = ids[keep], hashes[keep]
        if len(ids):
            order = np.argsort(ids, kind="stable")
            ids, hashes = ids[order], hashes[order]
            cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array([*cut, len(ids)], pa.int32()), pa.array(hashes.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), lists], ["doc_id", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from found(held)
                    held = []
                held.append(row)
        if held:
            yield from found(held)

    sorted_ = packed.repartition(parts, "part").sortWithinPartitions("part")
    return sorted_.mapInArrow(run, "doc_id long, hashes array<int>")


def _suffixes(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, which, place, around): the bytes around every shared anchor, zeros beyond its
    strings, then how far before it they begin, at least and at most; ``docs`` has doc_id, text, hashes, which."""
    column = np.arange(LEFT + RIGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch.column(1)):
                out: list[list[np.ndarray]] = [[], [], [], []]
                around = []
                ids = batch.column(0).slice(first, len(texts)).to_pylist()
                wanted = batch.column(2).slice(first, len(texts)).to_pylist()
                numbers = batch.column(3).slice(first, len(texts)).to_pylist()
                for doc, data, shared, which in zip(ids, _bytes(texts), wanted, numbers, strict=True):
                    at, hashes, begin, end = anchors(data)
                    low32 = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    keep = np.isin(low32, np.array(shared, dtype=np.int32))
                    at = at[keep]
                    low, high = (at - end[keep])[:, None], (at - begin[keep])[:, None]
                    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(RIGHT, np.uint8)])
                    inside = (column >= LEFT - high) & (column < LEFT + RIGHT - low)
                    bytes_ = np.where(inside, padded[at[:, None] + column], 0)
                    around.append(np.concatenate([bytes_, low, high], axis=1).astype(np.uint8))
                    columns = (hashes[keep].view(np.int64), np.full(len(at), doc), np.full(len(at), which), at)
                    for values, more in zip(out, columns, strict=True):
                        values.append(more.astype(np.int64))
                if around:
                    rows = np.concatenate(around)
                    raw = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(LEFT + RIGHT + 2), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]
                    ).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.concatenate(c)) for c in out), raw], ["anchor", "doc_id", "which", "place", "around"]
                    )

    return docs.mapInArrow(run, "anchor long, doc_id long, which long, place long, around binary")


def repeated(group: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Bit d of a row: the string that begins d bytes before its anchor is in a smaller text.

    Rows are anchors with the bytes around them that their strings cover; ``low`` to ``high`` are the d that count.
    """
    n = len(group)
    right = np.ascontiguousarray(np.pad(around[:, LEFT:], ((0, 0), (0, -RIGHT % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort([*right.T[::-1], group])
    # Common prefix of each suffix with the one before it; none across anchors.
    one, two = around[order[1:], LEFT:], around[order[:-1], LEFT:]
    differs = one != two
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), RIGHT)
    common = np.concatenate([[0], np.where(group[order[1:]] == group[order[:-1]], common, 0)])
    marks = np.zeros(n, dtype=np.int64)
    left = np.cumsum(np.concatenate([[True], group[order[1:]] != group[order[:-1]]]))
    of_left = np.empty(n, dtype=np.int64)
    of_left[order] = left
    first_order = order
    dense = of_left.copy()
    for d in range(SPAN):
        if d:
            # Induced: a stable pass by the byte before, within each anchor.
            byte = around[:, LEFT - d].astype(np.int64)
            key = dense * 256 + byte
            order = order[np.argsort(key[order], kind="stable")]
            pair = of_left[order] * 256 + byte[order]
            change = np.concatenate([[True], pair[1:] != pair[:-1]])
            of_left = np.empty(n, dtype=np.int64)
            of_left[order] = np.cumsum(change)
        # Equal strings: equal d bytes before the anchor, and RIGHT - d from it on.
        of_right = np.empty(n, dtype=np.int64)
        of_right[first_order] = np.cumsum(common < RIGHT - d)
        rows = order[(low[order] <= d) & (high[order] >= d)]
        if not len(rows):
            continue
        a, b = of_left[rows], of_right[rows]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        smallest = np.repeat(np.minimum.reduceat(doc[rows], cut), np.diff([*cut, len(rows)]))
        marks[rows[doc[rows] > smallest]] |= np.int64(1) << np.int64(d)
    return marks


def _marked(suffixes: DataFrame) -> DataFrame:
    """(doc_id, which, place, marks) of anchors with repeated strings; a task gets whole anchors, sorted."""

    def find(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        anchor, doc, which, place = (table[c].to_numpy() for c in ("anchor", "doc_id", "which", "place"))
        # Anchors of one text need no look.
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        several = np.repeat(np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut), np.diff([*cut, len(doc)]))
        if not several.any():
            return
        around = np.frombuffer(b"".join(table["around"].to_pylist()), dtype=np.uint8).reshape(len(doc), -1)
        anchor, doc, which, place, around = anchor[several], doc[several], which[several], place[several], around[several]
        low, high = around[:, -2].astype(np.int64), around[:, -1].astype(np.int64)
        marks = repeated(anchor, doc, low, high, around[:, :-2])
        hit = marks != 0
        if hit.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[hit]) for c in (doc, which, place, marks)], ["doc_id", "which", "place", "marks"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                done = int(np.searchsorted(anchor, anchor[-1]))
                if done:
                    yield from find(table.slice(0, done))
                    held = table.slice(done).to_batches()
                    rows -= done
        if held:
            yield from find(pa.Table.from_batches(held))

    return suffixes.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "doc_id long, which long, place long, marks long"
    )


def _cut(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n_removed, n_spans, kept_sha256, spans) from digest, doc_id, text, hits (place, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for data, hits in zip(_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                if hits:
                    place, marks = np.array([(h["place"], h["marks"]) for h in hits], dtype=np.int64).T
                    for d in range(SPAN):
                        start = place[(marks >> d) & 1 == 1] - d
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out[0].append(int(gone.sum()))
                out[1].append(len(turns) // 2)
                out[2].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
                out[3].append(turns.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.string()),
                    pa.array(out[3], pa.list_(pa.int32())),
                ],
                ["digest", "doc_id", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return docs.mapInArrow(
        run, "digest binary, doc_id long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"
    )


def _laid_out(texts: DataFrame) -> DataFrame:
    """The texts as a table bucketed by id in the shared folder."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"texts_{uuid.uuid4().hex}"
    (
        texts.write.format("parquet")
        .option("compression", "zstd")
        .option("path", shared_dir(spark, "suffix-texts"))
        .bucketBy(n, "doc_id")
        .saveAsTable(table)
    )
    return spark.table(table)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets: from, to, from ...)."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        data.alias("text"),
        F.unhex(F.sha2(data, 256)).alias("digest"),
        F.length(data).cast("long").alias("n_bytes"),
    )
    keys = stored(rows.select("doc_id", "digest", "n_bytes"), "suffix-rows")
    firsts = stored(keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "suffix-firsts")
    # Without later copies, laid out by id once: the joins below move no text.
    least = keys.filter((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull()).join(
        firsts.withColumnRenamed("doc_id", "least"), "digest"
    )
    of_id = least.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("doc_id") > F.col("least"), F.col("digest"))).alias("gone"), F.min("digest").alias("zero")
    )
    texts = _laid_out(
        rows.filter((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull())
        .hint("merge")
        .join(of_id, "doc_id")
        .filter(~F.array_contains("gone", F.col("digest")))
        .select(
            "doc_id", "digest", "text", F.when(F.col("digest") == F.col("zero"), 0).otherwise(F.xxhash64("digest")).cast("long").alias("which")
        )
    )
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(PARTS, 1 << (shuffled - 1).bit_length())
    shared = _shared(_packed(texts.select("doc_id", "text"), parts), parts)
    shared = shared.groupBy("doc_id").agg(F.flatten(F.collect_list("hashes")).alias("hashes"))
    marked = _marked(_suffixes(texts.join(shared, "doc_id").select("doc_id", "text", "hashes", "which")))
    hits = stored(marked, "suffix-marked").repartition("doc_id").groupBy("doc_id", "which").agg(
        F.collect_list(F.struct("place", "marks")).alias("hits")
    )
    # The key of this join is the id alone, by which the texts lie; the two bounds say which of its texts.
    hits = hits.withColumnRenamed("which", "of")
    cut = _cut(texts.join(hits, "doc_id").filter("which >= of and which <= of").select("digest", "doc_id", "text", "hits"))
    cut = cut.dropDuplicates(["digest", "doc_id"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    whole = F.lower(F.hex("digest"))
    copy = F.coalesce((F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    return (
        keys.join(firsts.withColumnRenamed("doc_id", "least"), "digest")
        .join(cut, ["digest", "doc_id"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", whole)).alias("kept_sha256"),
            F.when(copy, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(
                F.coalesce("spans", F.array().cast("array<int>"))
            ).alias("spans"),
        )
    )
