"""Time slices: range windows that stay parallel when one key holds most rows.

A window partitioned by key alone puts a whole key in one task. Here the time axis is cut
into slices of fixed length; each row is copied into the later slices it can influence
(its halo), windows are partitioned by (keys, slice), and the copies are dropped after.
A slice is never shorter than the halo, so a row is copied at most once or twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = "_slice"


def stored_time(df: DataFrame, ts: str, time: Column) -> Column:
    """A time in the type the column is stored in: a bare column against it reaches the scan."""
    return time.cast(df.schema[ts].dataType)


def slice_of(t: Column, length: int) -> Column:
    """Floor division in whole numbers, exact for any 64-bit time."""
    return ((t - F.pmod(t, F.lit(length))) / F.lit(length)).cast("long")


def slice_length(halo: int, length: int | None = None) -> int:
    """The slice to use for a halo: four halos long unless the caller says otherwise."""
    return max(length or 4 * halo, halo, 1)


def with_halo(df: DataFrame, t: str, halo: int, length: int | None = None) -> DataFrame:
    """Copy every row into each slice whose rows can see it through a look-back of ``halo``."""
    n = slice_length(halo, length)
    last = slice_of(F.col(t) + F.lit(halo), n)
    return df.withColumn(SLICE, F.explode(F.sequence(slice_of(F.col(t), n), last)))


def drop_halo(df: DataFrame, t: str, halo: int, length: int | None = None) -> DataFrame:
    """Keep each row only in its own slice."""
    n = slice_length(halo, length)
    return df.filter(F.col(SLICE) == slice_of(F.col(t), n)).drop(SLICE)


def over(keys: Sequence[str], t: str, lo: int, hi: int) -> WindowSpec:
    """A RANGE frame [t+lo, t+hi] inside (keys, slice)."""
    return Window.partitionBy(*keys, SLICE).orderBy(t).rangeBetween(lo, hi)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    frames: dict[str, tuple[Column, int, int]],
    length: int | None = None,
) -> DataFrame:
    """Add sliding aggregates: name -> (aggregate column, lo, hi) with lo <= hi <= 0."""
    halo = max(-lo for _, lo, _ in frames.values())
    out = with_halo(df, t, halo, length)
    out = out.withColumns({n: a.over(over(keys, t, lo, hi)) for n, (a, lo, hi) in frames.items()})
    return drop_halo(out, t, halo, length)


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    span: int,
    values: dict[str, Column],
    length: int | None = None,
) -> DataFrame:
    """Add the sum of each value over the rows of the key in [t - span, t], peers included.

    A RANGE frame that slides is summed anew for every row, which a busy key turns into
    rows times frame. Here a row enters the sums at its time and leaves them just after
    ``span``; one running sum over these two marks gives every window.
    """
    n = slice_length(span, length)
    copied = with_halo(df, t, span, n)
    marks = copied.select(
        *keys,
        SLICE,
        F.struct(*df.columns).alias("_r"),
        *[v.alias(f"_v_{k}") for k, v in values.items()],
        F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign"),
    )
    enters = F.col("_sign") == 1
    time = F.col(f"_r.{t}")
    marks = marks.withColumn("_at", F.when(enters, time).otherwise(time + F.lit(span + 1)))
    marks = marks.withColumn("_r", F.when(enters, F.col("_r")))
    run = Window.partitionBy(*keys, SLICE).orderBy("_at")
    sums = {k: F.sum(F.col(f"_v_{k}") * F.col("_sign")).over(run) for k in values}
    out = marks.withColumns({f"_s_{k}": c for k, c in sums.items()}).filter("_r is not null")
    out = out.select(SLICE, "_r.*", *[F.col(f"_s_{k}").alias(k) for k in values])
    return drop_halo(out, t, span, n)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    order: str,
    length: int,
    rank: str = "rn",
    total: str = "n",
) -> DataFrame:
    """Row number and row count per key without a window over a whole key.

    Rows are counted per slice, the few counts are summed up in time order, and rows are
    numbered inside their slice from there.
    """
    rows = df.withColumn(SLICE, slice_of(F.col(t), length))
    counts = rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(SLICE)
    counts = counts.select(
        *keys,
        SLICE,
        (F.sum("_c").over(before) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(t, order)
    out = rows.join(counts, [*keys, SLICE])
    return out.withColumn(rank, F.col("_before") + F.row_number().over(inside)).drop(
        SLICE, "_before"
    )
