"""Binned event series: counts, dense grids and sliding statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators import slices

# Sizes of the detector's window and short window, and its threshold.
WINDOW_BINS = 60
SHORT_BINS = 5
THRESHOLD = 3.0
# Fixed value: deviations at or below this count as no deviation.
MIN_STD = 0.001
DENSE_SLICE = 4096


def bin_of(ts: str = "ts", seconds: int = 1) -> Column:
    return F.expr(f"unix_seconds(cast({ts} as timestamp)) div {int(seconds)}")


def bin_counts(
    df: DataFrame, seconds: int = 1, keys: Sequence[str] = ("org",), ts: str = "ts"
) -> DataFrame:
    """Events per key and time bin; empty bins have no row."""
    return df.groupBy(*keys, bin_of(ts, seconds).alias("bin")).agg(F.count(F.lit(1)).alias("c"))


def timeline(
    df: DataFrame,
    now_bin: int,
    points: int = 120,
    seconds: int = 1,
    keys: Sequence[str] = ("org",),
    ts: str = "ts",
) -> DataFrame:
    """The last ``points`` bins and the current one, empty bins as 0."""
    lo = now_bin - points
    first, after = (slices.stored_time(df, ts, F.timestamp_seconds(F.lit(b * seconds))) for b in (lo, now_bin + 1))
    binned = df.filter((F.col(ts) >= first) & (F.col(ts) < after)).select(*keys, bin_of(ts, seconds).alias("bin"))
    inside = binned.filter(F.col("bin").between(lo, now_bin)).withColumn("n", F.lit(1))
    grid = (
        df.select(*keys)
        .distinct()
        .select(
            *keys,
            F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(now_bin).cast("long"))).alias("bin"),
            F.lit(0).alias("n"),
        )
    )
    return inside.unionByName(grid).groupBy(*keys, "bin").agg(F.sum("n").alias("c"))


def densify(series: DataFrame, keys: Sequence[str] = ("org",), length: int = DENSE_SLICE) -> DataFrame:
    """Fill the bins missing between a key's first and last bin with 0.

    The grid grows slice by slice: slices are spread over tasks before their bins are
    listed, so one long series is not built in one task.
    """
    span = series.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    parts = span.withColumn(
        "s",
        F.explode(
            F.sequence(
                slices.slice_of(F.col("lo"), length), slices.slice_of(F.col("hi"), length)
            )
        ),
    ).repartition(*keys, "s")
    grid = parts.select(
        *keys,
        F.explode(
            F.sequence(
                F.greatest("lo", F.col("s") * length),
                F.least("hi", F.col("s") * length + (length - 1)),
            )
        ).alias("bin"),
        F.lit(0).cast("long").alias("c"),
    )
    return series.select(*keys, "bin", "c").unionByName(grid).groupBy(*keys, "bin").agg(
        F.sum("c").alias("c")
    )


def _moments(
    series: DataFrame, keys: Sequence[str], lo: int, hi: int, length: int | None
) -> DataFrame:
    return slices.sliding(
        series,
        keys,
        "bin",
        {
            "_s": (F.sum("c"), lo, hi),
            "_q": (F.sum(F.col("c") * F.col("c")), lo, hi),
        },
        length,
    ).withColumns({"_s": F.coalesce("_s", F.lit(0)), "_q": F.coalesce("_q", F.lit(0))})


def zscore(
    series: DataFrame,
    window: int = WINDOW_BINS,
    keys: Sequence[str] = ("org",),
    length: int | None = None,
) -> DataFrame:
    """z of each bin against the ``window`` bins before it, missing bins counting 0.

    Sums over the bins that exist give the zero-filled mean and sample deviation, so no
    grid is built; the numerator stays a whole number and a flat history is exactly flat.
    """
    m = _moments(series, keys, -window, -1, length)
    spread = F.lit(window) * F.col("_q") - F.col("_s") * F.col("_s")
    std = F.sqrt(spread / F.lit(window * (window - 1)))
    mean = F.col("_s") / F.lit(window)
    z = F.when(spread > 0, (F.col("c") - mean) / std).otherwise(F.lit(0.0))
    return m.withColumns({"mean": mean, "std": std, "z": z}).drop("_s", "_q")


def rate_stats(
    series: DataFrame,
    window: int = WINDOW_BINS,
    keys: Sequence[str] = ("org",),
    min_std: float = MIN_STD,
    length: int | None = None,
) -> DataFrame:
    """z of each bin against the window that ends with it, population deviation."""
    m = _moments(series, keys, -(window - 1), 0, length)
    spread = F.lit(window) * F.col("_q") - F.col("_s") * F.col("_s")
    std = F.sqrt(spread / F.lit(window * window))
    mean = F.col("_s") / F.lit(window)
    z = F.when(std > min_std, (F.col("c") - mean) / std).otherwise(F.lit(0.0))
    return m.withColumns({"mean": mean, "std": std, "z": z}).drop("_s", "_q")


def burst_ratio(
    series: DataFrame,
    window: int = WINDOW_BINS,
    keys: Sequence[str] = ("org",),
    length: int | None = None,
) -> DataFrame:
    """Largest over mean count of the non-empty bins in the window that ends with a bin."""
    lo = -(window - 1)
    out = slices.sliding(
        series,
        keys,
        "bin",
        {
            "_max": (F.max("c"), lo, 0),
            "_sum": (F.sum("c"), lo, 0),
            "_n": (F.count("c"), lo, 0),
        },
        length,
    )
    ratio = F.col("_max") * F.col("_n") / F.col("_sum")
    return out.withColumn("burst_ratio", ratio).drop("_max", "_sum", "_n")


def _plogp(c: Column) -> Column:
    """c log2 c as a decimal: running sums of it come back exactly to where they were."""
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0)).cast("decimal(28,15)")


def sliding_distribution(
    df: DataFrame,
    category: str,
    window: int = WINDOW_BINS,
    seconds: int = 1,
    keys: Sequence[str] = ("org",),
    ts: str = "ts",
    length: int | None = None,
) -> DataFrame:
    """Total, distinct values and Shannon entropy of ``category`` per bin's trailing window.

    A value's count in the window changes only when a bin enters or leaves. Each
    (key, bin, value) count becomes one entering and one leaving change; running sums of
    the changes give every window, so the cost is twice the counts however long it is.
    """
    n = slices.slice_length(window, length)
    parts = df.groupBy(*keys, bin_of(ts, seconds).alias("bin"), category).agg(
        F.count(F.lit(1)).alias("n")
    )
    copied = slices.with_halo(parts, "bin", window, n)
    changes = copied.select(
        *keys,
        slices.SLICE,
        category,
        F.inline(
            F.array(
                F.struct(F.col("bin").alias("at"), F.col("n").alias("d"), F.lit(1).alias("e")),
                F.struct(
                    (F.col("bin") + window).alias("at"),
                    (-F.col("n")).alias("d"),
                    F.lit(0).alias("e"),
                ),
            )
        ),
    ).groupBy(*keys, slices.SLICE, category, "at").agg(
        F.sum("d").alias("d"), F.max("e").alias("e")
    )
    run = Window.partitionBy(*keys, slices.SLICE, category).orderBy("at")
    c = F.sum("d").over(run)
    steps = changes.withColumn("after", c).withColumn("before", F.col("after") - F.col("d"))
    per_bin = steps.groupBy(*keys, slices.SLICE, "at").agg(
        F.sum("d").alias("d"),
        F.sum((F.col("after") > 0).cast("int") - (F.col("before") > 0).cast("int")).alias("u"),
        F.sum(_plogp(F.col("after")) - _plogp(F.col("before"))).alias("p"),
        F.max("e").alias("e"),
    )
    w = Window.partitionBy(*keys, slices.SLICE).orderBy("at")
    out = per_bin.select(
        *keys,
        slices.SLICE,
        F.col("at").alias("bin"),
        "e",
        F.sum("d").over(w).alias("total"),
        F.sum("u").over(w).alias("distinct_values"),
        F.sum("p").over(w).alias("_p"),
    ).filter("e = 1")
    total = F.col("total")
    entropy = F.when(F.col("distinct_values") <= 1, F.lit(0.0)).otherwise(
        F.round(F.log2(total) - F.col("_p").cast("double") / total, 12)
    )
    return slices.drop_halo(out.withColumn("entropy", entropy), "bin", window, n).drop("_p", "e")


def feature_vectors(
    df: DataFrame,
    source: str = "source",
    window: int = WINDOW_BINS,
    short: int = SHORT_BINS,
    seconds: int = 1,
    keys: Sequence[str] = ("org",),
    ts: str = "ts",
) -> DataFrame:
    """Per bin: rate, source entropy, distinct sources, rate minus short rate, burst ratio."""
    series = bin_counts(df, seconds, keys, ts)
    rates = slices.sliding(
        burst_ratio(series, window, keys),
        keys,
        "bin",
        {
            "_long": (F.sum("c"), -(window - 1), 0),
            "_short": (F.sum("c"), -(short - 1), 0),
        },
    )
    mix = sliding_distribution(df, source, window, seconds, keys, ts).select(
        *keys, "bin", "entropy", F.col("distinct_values").alias("unique_sources")
    )
    rate = F.col("_long") / F.lit(window * seconds)
    return rates.join(mix, [*keys, "bin"]).select(
        *keys,
        "bin",
        "c",
        rate.alias("rate"),
        "entropy",
        "unique_sources",
        (rate - F.col("_short") / F.lit(short * seconds)).alias("acceleration"),
        "burst_ratio",
    )


def value_counts_in_window(
    df: DataFrame,
    category: str,
    window: int = WINDOW_BINS,
    seconds: int = 1,
    keys: Sequence[str] = ("org",),
    ts: str = "ts",
) -> DataFrame:
    """Count of each value in the trailing window of every non-empty bin, one row per value."""
    parts = (
        df.filter(F.col(category).isNotNull())
        .groupBy(*keys, bin_of(ts, seconds).alias("bin"), category)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = bin_counts(df, seconds, keys, ts).select(*keys, "bin")
    spread = parts.withColumn(
        "bin", F.explode(F.sequence(F.col("bin"), F.col("bin") + (window - 1)))
    )
    return (
        spread.groupBy(*keys, "bin", category)
        .agg(F.sum("n").alias("n"))
        .join(seen, [*keys, "bin"], "left_semi")
    )


def peak_near(alerts: DataFrame, series: DataFrame, reach: int = 3, keys: Sequence[str] = ("org",)) -> DataFrame:
    """Busiest bin within ``reach`` bins of each alert; one alert, the earliest, per peak."""
    near = alerts.select(
        *keys,
        F.col("id"),
        F.explode(F.sequence(F.col("bin") - reach, F.col("bin") + reach)).alias("bin"),
    )
    peaks = (
        near.join(series, [*keys, "bin"])
        .groupBy(*keys, "id")
        .agg(F.max_by(F.struct("bin", "c"), F.struct(F.col("c"), -F.col("bin"))).alias("p"))
        .select(*keys, "id", F.col("p.bin").alias("peak_bin"), F.col("p.c").alias("peak_count"))
    )
    return peaks.groupBy(*keys, "peak_bin").agg(
        F.min("id").alias("id"), F.first("peak_count").alias("peak_count")
    )
