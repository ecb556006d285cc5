"""Streaming twins of the batch queries, over files that arrive one after the other.

A table is dealt by time into ``STEPS`` steps, one per trigger; the last file has one
row far in the future, which moves the watermark past all others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.plans import logs
from watchtide.plans.detection import ALERTS, B, BINS, EWMA, GRID, W, ZS, HOUR, r
from watchtide.plans.registry import ORACLES, SIG, SIGNAL_TYPES, Tables, query
from watchtide.plans.rules import CORR, CORR_ALL, SCALE
from watchtide.session import shared_dir
from watchtide.sources import sinks
from watchtide.streaming import streams

DELAY = "1 hour"
DELAY_SECONDS = 3600
STEPS = 4
#: Rows of a file, about: a step of more rows comes in as many files.
FILE_ROWS = 50_000
#: Parts in which a time of more rows than a file's is cut.
SHARES = 1_000_000
END = dt.datetime(2100, 1, 1)


def _dealt(table: DataFrame, name: str, later: DataFrame | None = None, closed: bool = True) -> DataFrame:
    """``table`` as a stream of files in the order of ``ts``. Rows of ``later`` come a step after
    the rows of their time.

    A trigger takes a number of files, so all steps have the same number of them. No file is
    empty: a task that deals as many rows as there are files reaches them all, and there is one
    unless a step was read in more than ``FILE_ROWS`` tasks.
    """
    spark = table.sparkSession
    path = shared_dir(spark, name)
    files = 1
    cuts = _cuts(table)
    if cuts:

        def inside(k: int) -> Column:
            if k == 0:
                return cuts[0]
            return ~cuts[k - 1] if k == STEPS - 1 else ~cuts[k - 1] & cuts[k]

        steps = [table.filter(inside(k)) for k in range(STEPS)]
        sizes = list(table.agg(*[F.count_if(inside(k)) for k in range(STEPS)]).first())
        if later is not None:
            steps[1:] = [now.unionByName(later.filter(inside(k))) for k, now in enumerate(steps[1:])]
            more = later.agg(*[F.count_if(inside(k)) for k in range(STEPS - 1)]).first()
            sizes[1:] = [a + b for a, b in zip(sizes[1:], more, strict=True)]
        files = max(1, min(n for n in sizes if n) // FILE_ROWS)
        for rows, size in zip(steps, sizes, strict=True):
            if size:
                rows.repartition(files).write.mode("append").parquet(path)
    if closed or not cuts:
        _closing(table).write.mode("append").parquet(path)
    return streams.file_stream(spark, path, table.schema, maxFilesPerTrigger=files)


def _cuts(table: DataFrame) -> list[Column]:
    """For every cut between two steps of about as many rows, which rows come before it.

    Rows of one time share a step unless they fill more than a file: then a hash of the row puts
    them before or behind the cut, or a very common time would leave the other steps few rows
    and so, as all have the same number of files, its own step few files.
    """
    quarters = [k / STEPS for k in range(1, STEPS)]
    times = table.agg(F.percentile_approx("ts", quarters)).first()[0]
    if times is None:
        return []
    ts, cuts = F.col("ts"), []
    times = [F.lit(c).cast(table.schema["ts"].dataType) for c in times]
    counts = [F.count("ts"), *[F.count_if(ts < c) for c in times], *[F.count_if(ts == c) for c in times]]
    rows, *counts = table.agg(*counts).first()
    for quarter, time, below, at in zip(quarters, times, counts[: STEPS - 1], counts[STEPS - 1 :], strict=True):
        cut = ts < time
        if at > FILE_ROWS:
            share = round((quarter * rows - below) / at * SHARES)
            cut = cut | ((ts == time) & (F.pmod(F.xxhash64(*table.columns), F.lit(SHARES)) < share))
        cuts.append(cut)
    return cuts


def _closing(table: DataFrame) -> DataFrame:
    """A row at the end of time that belongs to nobody: -1 or "end" in every column."""
    nobody = [
        F.lit(END).cast(kind).alias(c) if c == "ts" else F.lit("end" if kind == "string" else -1).cast(kind).alias(c)
        for c, kind in table.dtypes
    ]
    return table.sparkSession.range(1).select(*nobody).coalesce(1)


def _events(t: Tables) -> DataFrame:
    return _dealt(t.events, "events")


def _sig(t: Tables, events: DataFrame | None = None) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in SIGNAL_TYPES.items() for x in pair])
    events = _events(t) if events is None else events
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") >= 0, F.col("user_id") % 4).otherwise(-1).alias("org"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("end")).alias("event_type"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user_name"),
        F.col("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _counts(t: Tables, *keys: str) -> DataFrame:
    """Closed hourly bins: the first stage, drained to a table."""
    return streams.drain(streams.bin_counts_stream(_sig(t), B, ["org", *keys], DELAY), "bins")


@query("stream_bin_counts", ORACLES["bin_counts"])
def _(t):
    return _counts(t).select("org", "bin", "c")


@query(
    "stream_detector",
    f"""WITH RECURSIVE {SIG}, {BINS}, {GRID}, {ZS}, {EWMA}
    SELECT zs.org, zs.bin, zs.c, round(zs.mean, 6) AS mean, round(zs.std, 6) AS std, round(zs.z, 6) AS z,
           round(ewma_z, 5) AS ewma_z FROM zs JOIN ewma ON ewma.org = zs.org AND ewma.bin = zs.bin""",
)
def _(t):
    found = streams.drain(streams.detector_stream(_dealt(_counts(t), "bins"), W), "detector")
    found = found.filter("org >= 0")
    return found.select("org", "bin", "c", r("mean"), r("std"), r("z"), r("ewma_z", 5))


@query(
    "stream_rolling",
    f"""WITH {SIG}, p AS (SELECT org, source, CAST(us // {B}000000 AS BIGINT) AS bin, count(*) AS n FROM sig GROUP BY 1, 2, 3),
    w AS (SELECT org, source, (bin + 1 + k) * {B} AS end_sec, sum(n) AS n FROM p, (SELECT unnest(generate_series(0, {W - 1})) AS k) GROUP BY 1, 2, 3),
    s AS (SELECT *, sum(n) OVER (PARTITION BY org, end_sec) AS t FROM w)
    SELECT org, CAST(end_sec AS BIGINT) AS end_sec, CAST(max(t) AS BIGINT) AS total, count(*) AS distinct_values,
           round(-sum(n / t * log2(n / t)) + 0, 6) AS entropy FROM s GROUP BY 1, 2""",
)
def _(t):
    counts = _dealt(_counts(t, "source"), "source-bins")
    out = streams.drain(streams.rolling_stream(counts, f"{W * B} seconds", f"{B} seconds", delay=DELAY), "rolling")
    return out.filter("org >= 0").select(
        "org", "end_sec", "total", "distinct_values", F.round(F.col("entropy") + 0.0, 6).alias("entropy")
    )


@query("stream_correlate", f"WITH {SIG}, {CORR} {CORR_ALL}")
def _(t):
    path = shared_dir(t.spark, "correlated")
    streams.correlate_batches(_sig(t), path, DELAY_SECONDS, scale=SCALE)
    return t.spark.read.parquet(f"{path}/incidents").select(
        "org", "rule_id", "severity", "entity_id", "trigger_id", "window_events", "matched_events", "first_seen", "last_seen"
    )


@query("stream_cooldown", ORACLES["alert_cooldown"])
def _(t):
    alerts = _sig(t).filter("value > 60 or id < 0")
    out = streams.drain(streams.cooldown_stream(alerts, 10 * HOUR, delay=DELAY), "cooldown")
    return out.filter("org >= 0").select("org", "us", "id")


@query("stream_rate_limit", ORACLES["hourly_rate_limit"])
def _(t):
    fires = _sig(t).withColumnRenamed("org", "playbook_id")
    out = streams.drain(streams.rate_limit_stream(fires, 2, delay=DELAY), "rate-limit")
    return out.filter("playbook_id >= 0").select("id", "playbook_id", "allowed")


@query("stream_quota", ORACLES["quota_admission"])
def _(t):
    batches = _sig(t).withColumns(
        {
            "day": F.expr("unix_micros(ts) div 86400000000"),
            "size": F.when(F.col("id") >= 0, 1 + (F.col("id") * 7) % 23).otherwise(0),
        }
    )
    out = streams.drain(streams.quota_stream(batches, 200, delay=DELAY), "quota")
    return out.filter("org >= 0").select("id", "org", "day", "accepted")


@query("stream_service_health", ORACLES["service_health"])
def _(t):
    checks = _sig(t).withColumn("service", F.when(F.col("id") >= 0, F.col("source")).otherwise("end"))
    bad = F.col("event_type").isin("login_failed", "data_export", "admin_add")
    out = streams.drain(streams.service_health_stream(checks, bad, delay=DELAY), "health")
    return out.filter("service <> 'end'").select("id", "service", "consecutive_failures", "status", "alert")


@query(
    "stream_dedup",
    f"WITH {SIG}, {ALERTS} SELECT org, sec, count(DISTINCT sec) AS n FROM alerts GROUP BY 1, 2",
)
def _(t):
    # Copies of every seventh alert come with it and again in a later file.
    again = F.col("event_id") % 7 == 0
    copy = t.events.filter(again).withColumn("event_id", F.col("event_id") + 100_000_000)
    events = _dealt(t.events.unionByName(copy), "alerts", later=copy.withColumn("event_id", F.col("event_id") * 2))
    alerts = _sig(t, events).filter("value > 60 or id < 0").withColumn("sec", F.unix_seconds("ts"))
    out = streams.drain(streams.dedup_stream(alerts, delay=DELAY), "dedup").filter("org >= 0")
    return out.groupBy("org", "sec").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_ingest",
    f"""WITH {logs.PARSED}
    SELECT event_id, parser, event_type, true AS valid, NULL AS reason FROM full_ev
    UNION ALL SELECT event_id, NULL, NULL, false, CASE WHEN event_id % 32 = 7 THEN 'Empty payload.'
      ELSE 'No parseable events found in payload.' END FROM lines WHERE event_id % 16 = 7""",
)
def _(t):
    # Line 7 of 16 is no event; every other one of those is blank.
    lines = logs.lines_of(_dealt(t.events, "lines", closed=False))
    lines = lines.withColumn("line", F.when(F.col("event_id") % 32 == 7, F.lit("  ")).otherwise(F.col("line")))
    path = shared_dir(t.spark, "ingest")
    streams.ingest_stream(lines, path, F.timestamp_seconds(F.lit(logs.NOW_SEC)), F.lit(logs.YEAR), order="event_id")
    events = t.spark.read.parquet(f"{path}/events").select("event_id", "parser", "event_type", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"))
    refused = t.spark.read.parquet(f"{path}/quarantine")
    return events.unionByName(
        refused.select("event_id", "parser", F.lit(None).cast("string").alias("event_type"), F.lit(False).alias("valid"), "reason")
    )


KEEP_SECONDS = 5 * 86_400


@query(
    "stream_retention",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR - INTERVAL 5 DAY",
)
def _(t):
    path = shared_dir(t.spark, "retained")
    events = _dealt(t.events, "to-keep", closed=False)
    streams.retention_stream(events, path, KEEP_SECONDS, DELAY_SECONDS)
    since = sinks.cutoff(t.spark, path, KEEP_SECONDS + DELAY_SECONDS)
    return sinks.stored_events(t.spark, path, since).select("event_id")
