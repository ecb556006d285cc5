"""What the operators share: words, running sums over hot keys, stored steps, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from watchtide.session import prepare, shared_dir, stored

__all__ = [
    "SPACE",
    "WORD",
    "components",
    "documents",
    "prepare",
    "running_start",
    "shared_dir",
    "stored",
    "words",
]

# What separates words, and a word.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def running_start(df: DataFrame, key: str, part: str, order: list, amount: str, out: str) -> DataFrame:
    """``out`` = sum of ``amount`` over the rows of ``key`` that come before, exactly.

    ``part`` cuts a key into ordered pieces (all of piece 0 before piece 1). Rows are sorted
    only within a piece, so a key that holds most rows is many tasks. Needs one shuffle of
    the rows on (key, part), which the join with the small sums of pieces reuses.
    """
    sums = df.groupBy(key, part).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, part).orderBy(*order)
    rows = df.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_in", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    )
    return (
        rows.join(sums, [key, part])
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_before", "_in")
    )


def _told(pairs: DataFrame) -> tuple:
    """Tells sets of pairs apart: their number and sums of two hashes of each."""
    half = [F.sum(F.shiftright(F.xxhash64("a", "b", F.lit(k)), 32)) for k in range(4)]
    return tuple(pairs.agg(F.count(F.lit(1)), *half).first())


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for linked nodes.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to
    its larger neighbours, then to its smaller ones. Only (node, smallest) pairs move, each
    aggregated before its shuffle; every round is a table in the shared folder, so a lost
    executor costs one round. Edges never come to the driver.
    """
    spark = edges.sparkSession
    pairs = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    if pairs.isEmpty():
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))

    def smallest(both: DataFrame) -> DataFrame:
        return both.groupBy("a").agg(F.min("b").alias("m"))

    told = _told(pairs)
    while True:
        # Larger neighbours of a node go to the node's smallest neighbour.
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = smallest(both).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Then a node and its smaller neighbours all go to the smallest of them.
        low = smallest(large)
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        after = stored(small.filter("a <> b").distinct(), name)
        pairs, before, told = after, told, _told(after)
        if told == before:
            break
    found = pairs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return found.union(pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
