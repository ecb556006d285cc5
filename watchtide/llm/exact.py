"""Exact duplicates against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per
digest (partial sums before the shuffle, so a text with very many copies is no hot group),
then a sort-merge anti-join finds what the index lacks, and only that is appended. Texts
are read and hashed once; ids and digests are stored.

Defined cases: null text counts as empty, texts that are empty after normalising are equal
to each other; repeated rows are copies of one text (a row with the kept id stays); an
empty batch appends nothing; a null id never stays while a copy has an id; other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm.common import SPACE, shared_dir, stored

BUCKETS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far: ``digest``, ``keep_id``. Reopen it by table name."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = BUCKETS):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
        """An empty index in the shared folder."""
        return cls(spark, f"digests_{uuid.uuid4().hex}", shared_dir(spark, "digests"), buckets)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def lacking(self, firsts: DataFrame) -> DataFrame:
        """Of (digest, keep_id) rows those whose digest the index lacks."""
        if not self.exists():
            return firsts
        return firsts.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append(self, firsts: DataFrame) -> None:
        """Add (digest, keep_id) rows whose digest the index lacks."""
        new = self.lacking(firsts)
        (
            new.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )


def _firsts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", cuts: Sequence[int] = ()
) -> DataFrame:
    """Add ``docs`` to the index; per row: id, keep_id, group_size (in ``docs``), kept, text_sha256.

    A digest that an earlier batch brought keeps that batch's id. With ``cuts``, ids up to
    each cut are a batch of their own, smaller ids first, and rows without an id come last.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    rows = stored(rows, "exact-digests")
    left = rows
    for cut in sorted(cuts):
        index.append(_firsts(left.filter(F.col("doc_id") <= cut)))
        left = left.filter(F.col("doc_id").isNull() | (F.col("doc_id") > cut))
    index.append(_firsts(left))
    sizes = _firsts(rows).select("digest", "group_size").hint("merge").join(index.read(), "digest")
    return rows.join(sizes, "digest").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
