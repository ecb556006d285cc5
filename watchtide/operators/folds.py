"""Path-dependent folds over time, cut into slices that tasks work on independently.

Each fold runs in three steps: every (key, slice) reduces to a small summary of what it
does to the state that enters it; the summaries of a key, few and small, are chained in
time order; every slice is then finished from its entering state. No task ever holds a
whole key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.operators import slices
from watchtide.operators.series import MIN_STD

# Smoothing and its allowed range, cooldown and the length of a rate window.
EWMA_ALPHA = 0.15
EWMA_RANGE = (0.01, 1.0)
COOLDOWN_SECONDS = 10
RATE_WINDOW_SECONDS = 3600
MICROS = 1_000_000
EWMA_SLICE = 2048
#: Length of a slice of greedy anchors, in gaps.
SLICE_GAPS = 16


def _key_schema(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _schema(df: DataFrame, keys: Sequence[str], **fields: T.DataType) -> T.StructType:
    return T.StructType(
        _key_schema(df, keys) + [T.StructField(n, t) for n, t in fields.items()]
    )


def ewma(
    series: DataFrame,
    alpha: float = EWMA_ALPHA,
    keys: Sequence[str] = ("org",),
    value: str = "c",
    t: str = "bin",
    length: int = EWMA_SLICE,
    fill: bool = False,
) -> DataFrame:
    """Exponentially weighted mean, deviation and z of a series whose missing bins are 0.

    Only bins that exist are looked at; a gap is a power of what a bin leaves. Mean and
    variance after a slice are linear and quadratic in the mean that enters it, so a few
    numbers per slice say what it does to any state. They are kept relative to the slice's
    first value, so that large counts lose no digits. ``fill`` adds the rows of missing
    bins, each from the bin before its gap.
    """
    a = min(max(alpha, EWMA_RANGE[0]), EWMA_RANGE[1])
    r = 1.0 - a
    keys = list(keys)
    point = F.struct(F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("x"))
    parts = series.groupBy(*keys, slices.slice_of(F.col(t), length).alias("_s")).agg(F.array_sort(F.collect_list(point)).alias("xs"))

    first, last = F.element_at("xs", 1), F.element_at("xs", -1)
    x0 = first["x"]

    def step(acc: Column, e: Column) -> Column:
        # The bins of 0 before this one leave ``left`` of mean and deviation; then its own value.
        left, u = e["left"], acc["b"] + x0
        lost = left * (1.0 - left)
        p, b = acc["p"] * left, acc["b"] * left - x0 * (1.0 - left)
        d = e["x"] - x0 - b
        return F.struct(
            (p * r).alias("p"),
            (b * r + (e["x"] - x0) * a).alias("b"),
            ((acc["v"] * left + u * u * lost + a * d * d) * r).alias("v"),
            ((acc["q"] * left + 2 * u * acc["p"] * lost - 2 * a * d * p) * r).alias("q"),
            ((acc["w"] * left + acc["p"] * acc["p"] * lost + a * p * p) * r).alias("w"),
        )

    def gapped(e: Column, i: Column) -> Column:
        gap = F.when(i > 0, e["t"] - F.element_at("xs", i)["t"] - 1).otherwise(0)
        return F.struct(e["x"].alias("x"), F.pow(F.lit(r), gap).alias("left"))

    start = F.struct(*[F.lit(float(n == "p")).alias(n) for n in "pbvqw"])
    summaries = parts.select(
        *keys, "_s", first["t"].alias("first"), last["t"].alias("last"), x0.alias("x0"),
        F.aggregate(F.transform("xs", gapped), start, step).alias("f"),
    ).select(*keys, "_s", "first", "last", "x0", "f.*")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        m, v, end = float(pdf["x0"].iloc[0]), 0.0, int(pdf["first"].iloc[0]) - 1
        m_in, v_in = np.empty(len(pdf)), np.empty(len(pdf))
        columns = zip(*(pdf[c].tolist() for c in ("first", "last", "x0", "p", "b", "v", "q", "w")), strict=True)
        for i, (begin, last, x0, p, b, v0, q, w) in enumerate(columns):
            left = r ** (begin - end - 1)
            m, v, end = m * left, v * left + m * m * left * (1.0 - left), last
            m_in[i], v_in[i] = m, v
            d = m - x0
            m, v = x0 + (p * d + b), p * v + v0 + q * d + w * d * d
        return pdf[[*keys, "_s"]].assign(m_in=m_in, v_in=v_in)

    entering = summaries.groupBy(*keys).applyInPandas(
        chain, _schema(series, keys, _s=T.LongType(), m_in=T.DoubleType(), v_in=T.DoubleType())
    )
    double = T.DoubleType()
    schema = _schema(series, keys, **{t: T.LongType(), value: double}, ewma_mean=double, ewma_std=double, ewma_z=double)
    out = [f.name for f in schema]

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for row in pdf.itertuples(index=False, name=None):
                key, (xs, m, v) = row[: len(keys)], row[len(keys) :]
                last = None
                for e in xs:
                    at, x = e["t"], e["x"]
                    gap = 0 if last is None else at - last - 1
                    if gap:
                        left = r**gap
                        m, v = m * left, v * left + m * m * left * (1.0 - left)
                    d = x - m
                    m, v, last = a * x + r * m, r * (v + a * d * d), at
                    std = v**0.5 if v > 0 else 0.0
                    made.append((*key, at, x, m, std, (x - m) / std if std > MIN_STD else 0.0))
            yield pd.DataFrame(made, columns=out)

    found = parts.join(entering, [*keys, "_s"]).select(*keys, "xs", "m_in", "v_in").mapInPandas(finish, schema)
    if not fill:
        return found
    # Of a gap: all bins up to the next one that exists; a row of the next slice may follow.
    n = slices.slice_of(F.col(t), length)
    firsts = parts.select(*keys, "_s", first["t"].alias("_first"))
    after = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_s"))).drop("_first")
    inside = Window.partitionBy(*keys, "_s").orderBy(t)
    rows = found.withColumn("_s", n).join(after, [*keys, "_s"])
    until = F.coalesce(F.lead(t).over(inside), F.col("_next"), F.col(t) + 1)
    rows = rows.withColumn("_until", until)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_until") - F.col(t) - 1)))
    left = F.pow(F.lit(r), F.col("_k"))
    mean = F.col("ewma_mean") * left
    std = F.sqrt(F.col("ewma_std") * F.col("ewma_std") * left + F.col("ewma_mean") * F.col("ewma_mean") * left * (1.0 - left))
    own = F.col("_k") == 0
    return rows.select(
        *keys,
        (F.col(t) + F.col("_k")).alias(t),
        F.when(own, F.col(value)).otherwise(0.0).alias(value),
        mean.alias("ewma_mean"),
        F.when(own, F.col("ewma_std")).otherwise(std).alias("ewma_std"),
        F.when(own, F.col("ewma_z")).otherwise(F.when(std > MIN_STD, -mean / std).otherwise(0.0)).alias("ewma_z"),
    )


def _jumps(ts: np.ndarray, first: int, gap: int) -> list[int]:
    """Positions reached from ``first`` by always moving to the first time more than gap later."""
    out, i = [], first
    while i < len(ts):
        out.append(i)
        i = int(np.searchsorted(ts, ts[i] + gap, side="right"))
    return out


def anchors(
    times: DataFrame, keys: Sequence[str], t: str, gap: int, length: int | None = None
) -> DataFrame:
    """For each distinct time of a key, the latest anchor at or before it.

    The first time is an anchor; the next is the first time more than ``gap`` after the
    last. Greedy cooldowns and windows that open at their first event both work this way.

    What a slice of ``length`` does is a step function: the time it is entered at (within its
    first ``gap``) to its last anchor. Ways through a slice meet, so only the break points
    of that function go to the chaining step, far fewer than the times in the first ``gap``.
    """
    keys = list(keys)
    n = length or SLICE_GAPS * gap
    if n < gap:
        raise ValueError("a slice must be at least as long as the gap")
    rows = times.select(
        *keys, slices.slice_of(F.col(t), n).alias("_s"), F.col(t).cast("long").alias("_t")
    ).distinct()

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["_t"].to_numpy())
        nxt = np.searchsorted(ts, ts + gap, side="right")
        last = np.where(nxt < len(ts), nxt, np.arange(len(ts)))
        while (last[last] != last).any():  # jump twice as far each time
            last = last[last]
        start = int(pdf["_s"].iloc[0]) * n
        entries = min(int(np.searchsorted(ts, start + gap, side="left")) + 1, len(ts))
        leave = last[:entries]
        steps = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))  # the last entry of each exit
        out = pd.DataFrame({"entry": ts[steps], "exit": ts[leave[steps]]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out.assign(_s=int(pdf["_s"].iloc[0]))[[*keys, "_s", "entry", "exit"]]

    long = T.LongType()
    summaries = rows.groupBy(*keys, "_s").applyInPandas(
        exits, _schema(times, keys, _s=long, entry=long, exit=long)
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "entry"])
        found, anchor_in, last = [], [], None
        for s, part in pdf.groupby("_s", sort=True):
            found.append(s)
            anchor_in.append(-1 if last is None else last)
            entry, leave = part["entry"].to_numpy(), part["exit"].to_numpy()
            i = 0 if last is None else int(np.searchsorted(entry, last + gap, side="right"))
            if i < len(entry):
                last = int(leave[i])  # entered at the first time after the gap, up to this break point
        out = pd.DataFrame({"_s": found, "anchor_in": anchor_in, "has_in": [False] + [True] * (len(found) - 1)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_s", "anchor_in", "has_in"]]

    entering = summaries.groupBy(*keys).applyInPandas(
        chain, _schema(times, keys, _s=long, anchor_in=long, has_in=T.BooleanType())
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        ts = pdf["_t"].to_numpy()
        has, at = bool(pdf["has_in"].iloc[0]), int(pdf["anchor_in"].iloc[0])
        first = int(np.searchsorted(ts, at + gap, side="right")) if has else 0
        marks = np.array(_jumps(ts, first, gap), dtype="int64")
        got = np.concatenate([np.array([at], dtype="int64"), ts[marks]])
        out = got[np.searchsorted(marks, np.arange(len(ts)), side="right")]
        return pdf[[*keys, "_t"]].rename(columns={"_t": t}).assign(anchor=out)

    return (
        rows.join(entering, [*keys, "_s"])
        .groupBy(*keys, "_s")
        .applyInPandas(finish, _schema(times, keys, **{t: long}, anchor=long))
    )


def alert_cooldown(
    alerts: DataFrame,
    seconds: int = COOLDOWN_SECONDS,
    keys: Sequence[str] = ("org",),
    us: str = "us",
    order: str = "id",
) -> DataFrame:
    """Alerts still sent when each must come more than ``seconds`` after the last sent one."""
    keys = list(keys)
    firsts = alerts.groupBy(*keys, us).agg(F.min(order).alias(order))
    sent = anchors(firsts, keys, us, seconds * MICROS).filter(F.col("anchor") == F.col(us))
    picked = firsts.join(sent.select(*keys, us), [*keys, us]).select(order)
    return alerts.join(picked, order, "left_semi")


def hourly_rate_limit(
    fires: DataFrame,
    limit: int,
    keys: Sequence[str] = ("playbook_id",),
    us: str = "us",
    order: str = "id",
    seconds: int = RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Flag the first ``limit`` fires of each window that opens at a fire and lasts an hour."""
    keys = list(keys)
    opened = anchors(fires, keys, us, seconds * MICROS)
    rank = Window.partitionBy(*keys, "anchor").orderBy(us, order)
    allowed = (
        fires.select(*keys, us, order)
        .join(opened, [*keys, us])
        .withColumn("rn", F.row_number().over(rank))
        .filter(F.col("rn") <= limit)
        .select(order, F.lit(True).alias("allowed"))
    )
    out = fires.join(allowed, order, "left")
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def _admit(sizes: np.ndarray, room: int, taken: np.ndarray) -> int:
    """Mark what is accepted in order, and return its sum.

    Whatever exceeds the room once never fits again, so each turn takes all that fits up to
    the first that does not, and goes on with the rest of the sizes that still can.
    """
    total, left = 0, np.flatnonzero(sizes <= room)
    while len(left):
        sums = np.cumsum(sizes[left])
        n = int(np.searchsorted(sums, room - total, side="right"))
        taken[left[:n]] = True
        total += int(sums[n - 1]) if n else 0
        left = left[n:]
        left = left[sizes[left] <= room - total]
    return total


def quota_admission(
    batches: DataFrame,
    limit: int | None,
    keys: Sequence[str] = ("org", "day"),
    size: str = "size",
    us: str = "us",
    order: str = "id",
    slice_us: int = 3600 * MICROS,
) -> DataFrame:
    """Accept each batch whole while the day's total stays within ``limit``.

    Room only shrinks, so of one size only the first ``limit // size`` batches of a day can
    be accepted: had a later one fitted, all earlier ones had too, and together they exceed
    the limit. Those are found by counting per slice, whatever the number of batches, and
    only they are gone through in order, runs at a time, with one running total and no group in memory.
    """
    if limit is None:
        return batches.withColumn("accepted", F.lit(True))
    keys = list(keys)
    part = [*keys, size]
    sized = batches.select(
        *keys, size, us, order, slices.slice_of(F.col(us), slice_us).alias("_s")
    ).filter((F.col(size) > 0) & (F.col(size) <= limit))
    counts = sized.groupBy(*part, "_s").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*part).orderBy("_s")) - F.col("n")
    room = F.floor(F.lit(limit) / F.col(size))
    open_slices = counts.withColumn("before", before).filter(F.col("before") < room)
    rank = F.row_number().over(Window.partitionBy(*part, "_s").orderBy(us, order))
    possible = (
        sized.join(open_slices.select(*part, "_s", "before"), [*part, "_s"])
        .withColumn("rn", rank)
        .filter(F.col("before") + F.col("rn") <= room)
        .select(*keys, us, order, size)
    )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, 0
        for pdf in frames:
            taken = np.zeros(len(pdf), dtype=bool)
            sizes = pdf[size].to_numpy()
            day = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()
            starts = [0, *(np.flatnonzero(day[1:]) + 1), len(pdf)]
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(pdf[keys].iloc[a]) if b > a else current
                current, used = key, used if key == current else 0
                used += _admit(sizes[a:b], limit - used, taken[a:b])
            yield pd.DataFrame({order: pdf[order][taken]})

    accepted = (
        possible.repartition(*keys)
        .sortWithinPartitions(*keys, us, order)
        .mapInPandas(walk, T.StructType([batches.schema[order]]))
        .withColumn("accepted", F.lit(True))
    )
    out = batches.join(accepted, order, "left")
    return out.withColumn("accepted", F.coalesce("accepted", F.col(size) <= 0))


# Fixed value: consecutive failures that make a service unhealthy.
FAILURE_THRESHOLD = 3


def service_health(
    checks: DataFrame,
    failed: Column,
    keys: Sequence[str] = ("service",),
    us: str = "us",
    order: str = "id",
    slice_us: int = 3600 * MICROS,
) -> DataFrame:
    """Consecutive failures, status and alert after each health check.

    Runs of failures are counted inside slices and carried over slice ends by the length
    of the run each slice closes with.
    """
    keys = list(keys)
    rows = checks.withColumns(
        {"_bad": failed.cast("long"), "_s": slices.slice_of(F.col(us), slice_us)}
    )
    in_slice = Window.partitionBy(*keys, "_s").orderBy(us, order)
    island = F.sum(1 - F.col("_bad")).over(in_slice)
    rows = rows.withColumn("_island", island)
    inside = Window.partitionBy(*keys, "_s", "_island").orderBy(us, order)
    rows = rows.withColumn("_run", F.sum("_bad").over(inside))
    ends = rows.groupBy(*keys, "_s").agg(
        F.max_by("_run", F.struct(us, order)).alias("run"), F.max("_island").alias("good")
    )
    by_slice = Window.partitionBy(*keys).orderBy("_s")
    group = F.sum((F.col("good") > 0).cast("long")).over(by_slice)
    ends = ends.withColumn("g", group)
    total = F.sum("run").over(Window.partitionBy(*keys, "g").orderBy("_s"))
    ends = ends.withColumn("out", total)
    carry = F.coalesce(F.lag("out").over(by_slice), F.lit(0))
    rows = rows.join(ends.select(*keys, "_s", carry.alias("_carry")), [*keys, "_s"])
    fails = F.col("_run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    rows = rows.withColumn("consecutive_failures", fails)
    prior = F.coalesce(F.lag("consecutive_failures").over(in_slice), F.col("_carry"))
    n, bad = F.col("consecutive_failures"), F.col("_bad") == 1
    status = (
        F.when(~bad, "healthy").when(n >= FAILURE_THRESHOLD, "unhealthy").otherwise("degraded")
    )
    alert = (
        F.when(bad & (n == 1), "warning")
        .when(bad & (n == FAILURE_THRESHOLD), "critical")
        .when(~bad & (prior >= FAILURE_THRESHOLD), "resolved")
    )
    return rows.withColumn("_prior", prior).withColumns({"status": status, "alert": alert}).drop(
        "_bad", "_s", "_island", "_run", "_carry", "_prior"
    )
