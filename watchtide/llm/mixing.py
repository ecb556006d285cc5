"""Mixing sources to target weights by a low-discrepancy schedule.

Targets come from weights by water filling. The rows of a source are shuffled by a hash and
laid end to end (a source may be read twice); the line is cut into blocks of equal tokens.
Slot t of the mix belongs to the source whose share of [0, 1) holds the fractional part of
t times the golden ratio; a slot's rank within its source names the block it takes. The
last block of a source ends where its target is reached.

Defined cases: null text has no words; a null source is a source of its own, last; rows
without words take nothing; repeated rows are rows of their own; an empty table gives an
empty result; other columns are ignored. A block whose source got no slot left (targets far
below one block) is put after the last slot, so every target is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchtide.llm.common import WORD, running_start, stored

# The weights, repeating over sources in code point order; the mix's size
# against the input; the most a source may give against its size.
WEIGHTS = (5, 2, 1)
FACTOR = 1.5
MOST = 2.0
GOLDEN = 0.6180339887498949
BLOCK_TOKENS = 2048
#: Rows sorted in one task.
PIECE_ROWS = 4096
SEED = 17


def row_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Names a row by its id and whole text, and gives its place in the shuffle."""
    return F.xxhash64(F.lit(seed), doc_id, F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, weights=WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(sid, source, source_size, target, lo, hi) from (source, source_size).

    A source below ``most`` times its size gets ``level`` times its weight. Sorted by
    cap / weight, the capped sources come first, so one running sum finds the level. One
    row per source: the only step that sorts everything in one task.
    """
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "w", cyc[(F.col("sid") % len(weights)).cast("int")]
    )
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(factor)
    rows = rows.withColumn("total", total).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards)
    )
    rows = rows.withColumn("free", F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level")))
    rows = rows.withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.max("free").over(Window.partitionBy()) * F.col("w"), F.col("cap")))
    )
    up = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    rows = rows.withColumn("hi", F.when(whole > 0, F.sum("target").over(up) / whole).otherwise(0.0))
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    return rows.select("sid", "source", "source_size", "target", "lo", "hi")


def slots(spark, sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """(sid, rank, slot): slot t goes to the source whose share holds frac(t * golden).

    The unit interval is cut into cells; a source's share is the cells it touches, so the
    lookup is an equality join on the cell.
    """
    cells = 1 << max(4, math.ceil(math.log2(max(1, n_sources))) + 2)
    shares = sources.filter("hi > lo").select(
        "sid",
        "lo",
        F.when(F.col("hi") >= F.max("hi").over(Window.partitionBy()), 2.0).otherwise(F.col("hi")).alias("hi"),
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * cells).cast("int"),
                F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int"),
            )
        ).alias("cell"),
    )
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("u")
    )
    points = points.withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    mine = (
        points.join(shares, "cell")
        .filter("u >= lo and u < hi")
        .select("sid", "slot", F.floor(F.col("slot") / PIECE_ROWS).alias("part"), F.lit(1).alias("one"))
    )
    return running_start(mine, "sid", "part", ["slot"], "one", "rank").select("sid", "rank", "slot")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    weights=WEIGHTS,
    factor: float = FACTOR,
    most: float = MOST,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words), first_slot, row_key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            row_key(F.col(id_col), F.col(text_col), seed).alias("h"),
        ),
        "mix-rows",
    )
    per_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    sources = stored(targets(per_source.select("source", "source_size"), weights, factor, most), "mix-sources")
    told = sources.agg(F.count(F.lit(1)).alias("k"), F.sum("target").alias("t")).first()
    n_slots = math.ceil((told.t or 0) / block_tokens)
    n_slots += math.isqrt(n_slots) + 8
    bits = max(4, math.ceil(math.log2(max(1, rows.count() / PIECE_ROWS))))
    lined = rows.join(
        sources.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))
    ).withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    lined = running_start(lined, "sid", "part", ["h", "doc_id", "size"], "size", "start")
    goal = F.floor("target").cast("long")
    pieces = (
        lined.withColumn("goal", goal)
        .withColumn("at", F.explode(F.array(F.col("start"), F.col("start") + F.col("source_size"))))
        .withColumn("end", F.least(F.col("at") + F.col("size"), F.col("goal")))
        .withColumn(
            "rank",
            F.explode_outer(
                F.when(
                    F.col("end") > F.col("at"),
                    F.sequence(
                        F.floor(F.col("at") / block_tokens), F.floor((F.col("end") - 1) / block_tokens)
                    ),
                )
            ),
        )
        .withColumn(
            "words",
            F.when(
                F.col("rank").isNotNull(),
                F.least(F.col("end"), (F.col("rank") + 1) * block_tokens)
                - F.greatest(F.col("at"), F.col("rank") * block_tokens),
            ).otherwise(0),
        )
    )
    placed = pieces.join(slots(spark, sources, told.k, n_slots), ["sid", "rank"], "left")
    slot = F.when(F.col("rank").isNotNull(), F.coalesce("slot", F.lit(n_slots) + F.col("rank")))
    return (
        placed.groupBy("sid", "part", "_row", "h", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").cast("long").alias("taken"), F.min(slot).alias("first_slot"))
        .select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken", "first_slot", F.col("h").alias("row_key"))
    )
