"""Rolling behaviour of single events over the seconds before them, both ends included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators import slices

MICROS = 1_000_000
# Event types that count as failed authentication.
FAILED_AUTH = ("failed_login", "auth_failure")
# Severities that count towards anomaly density.
DENSE_SEVERITIES = ("HIGH", "CRITICAL")


def entity(name: str) -> Column:
    """Users compare without case and surrounding blanks."""
    return F.lower(F.trim(F.col(name)))


def rolling(
    df: DataFrame,
    values: dict[str, Column],
    seconds: int,
    keys: Sequence[str] = ("org",),
    us: str = "us",
) -> DataFrame:
    """Add sums of row values over the rows of the same key with ``t - seconds <= time <= t``."""
    return slices.sliding_sums(df, keys, us, seconds * MICROS, values)


def rolling_rate(
    df: DataFrame, seconds: int, keys: Sequence[str] = ("org",), us: str = "us", name: str = "rate"
) -> DataFrame:
    out = rolling(df, {name: F.lit(1).cast("long")}, seconds, keys, us)
    return out.withColumn(name, F.col(name) / seconds)


def failed_auth(types: Sequence[str] = FAILED_AUTH) -> Column:
    """1 for a failed authentication."""
    return F.coalesce(F.col("event_type").isin(*types), F.lit(False)).cast("long")


def bytes_moved(column: str = "bytes") -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("long")


def anomaly_density(severity: str = "severity", flag: str = "is_anomaly") -> Column:
    """1 for a severe or flagged event."""
    hit = F.col(severity).isin(*DENSE_SEVERITIES) | F.col(flag)
    return F.coalesce(hit, F.lit(False)).cast("long")


def unique_in_window(
    df: DataFrame,
    column: str,
    seconds: int,
    keys: Sequence[str] = ("org",),
    us: str = "us",
    name: str = "unique_values",
    order: str = "id",
) -> DataFrame:
    """Distinct values of ``column`` in each row's window, missing values not counted.

    A row is the latest of its value from its own time until the value returns or leaves
    the window. Counting the rows that are latest at a time counts the values, so two
    changes per row and a running sum replace a set per frame.
    """
    span = seconds * MICROS
    n = slices.slice_length(span)
    copied = slices.with_halo(df, us, span, n)
    same = Window.partitionBy(*keys, slices.SLICE, column).orderBy(us, order)
    gone = F.col(us) + F.lit(span + 1)
    again = F.lead(us).over(same)
    known = F.col(column).isNotNull()
    marked = copied.withColumns(
        {
            "_in": known.cast("long"),
            "_out": F.when(known, F.least(F.coalesce(again, gone), gone)),
        }
    )
    marks = marked.select(
        "*",
        F.inline(
            F.array(
                F.struct(F.col(us).alias("_at"), F.col("_in").alias("_d"), F.lit(True).alias("_row")),
                F.struct(
                    F.col("_out").alias("_at"),
                    F.lit(-1).cast("long").alias("_d"),
                    F.lit(False).alias("_row"),
                ),
            )
        ),
    ).filter("_at is not null")
    run = Window.partitionBy(*keys, slices.SLICE).orderBy("_at")
    counted = marks.withColumn(name, F.sum("_d").over(run)).filter("_row")
    return slices.drop_halo(
        counted.drop("_in", "_out", "_at", "_d", "_row"), us, span, n
    )
