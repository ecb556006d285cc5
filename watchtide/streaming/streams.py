"""The detectors, rules and folds on Structured Streaming.

Counts leave Spark's own windowed aggregation first, so per-key state sees one row per key
and bin instead of every event. Folds over single events keep a key's rows until the
watermark passes them and then run in event time (``keyed``), so late rows within the
watermark change nothing and results equal the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from watchtide.operators import correlate as rules
from watchtide.operators import normalize
from watchtide.operators.folds import COOLDOWN_SECONDS, EWMA_ALPHA, EWMA_RANGE, FAILURE_THRESHOLD
from watchtide.operators.folds import RATE_WINDOW_SECONDS
from watchtide.operators.series import MIN_STD, WINDOW_BINS
from watchtide.session import shared_dir
from watchtide.sources import sinks
from watchtide.streaming import keyed

STORE = "spark.sql.streaming.stateStore.providerClass"
MICROS = 1_000_000
# Seconds correlation state outlives its last signal; why a line is refused.
CORRELATION_TTL = 30 * 60
EMPTY_LINE = "Empty payload."
NO_EVENTS = "No parseable events found in payload."


def start(writer: DataStreamWriter, spark: SparkSession, path: str | None = None) -> StreamingQuery:
    """Start a stream with the state store that timers and several states of a key need.

    A query keeps the settings it was started with; the session's are left as they were.
    """
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, keyed.PROVIDER)
    try:
        return writer.start(path) if path else writer.start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def each_batch(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand all micro-batches there are to ``write(batch, batch id)``.

    A batch that fails half way comes again with its id, so ``write`` must replace what it
    wrote for that id.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", shared_dir(spark, f"{name}-state"))
    start(writer.trigger(availableNow=True), spark).awaitTermination()


def drain(stream: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process all data there is and return what the file sink holds."""
    spark = stream.sparkSession
    out, checkpoint = shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    start(writer.outputMode("append").trigger(availableNow=True), spark, out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def bin_counts_stream(
    events: DataFrame,
    seconds: int = 1,
    keys: Sequence[str] = ("org",),
    delay: str = "10 seconds",
    ts: str = "ts",
) -> DataFrame:
    """Counts per key and closed bin; ``ts`` is the bin's last instant, for the next stage."""
    window = F.window(ts, f"{seconds} seconds")
    counted = events.withWatermark(ts, delay).groupBy(window.alias("w"), *keys)
    return counted.agg(F.count(F.lit(1)).alias("c")).select(
        *keys,
        F.expr(f"unix_seconds(w.start) div {seconds}").alias("bin"),
        F.window_time("w").alias("ts"),
        "c",
    )


def _merge(fields: Sequence[T.StructField], extra: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*fields, *[T.StructField(n, k) for n, k in extra.items()]])


def detector_stream(
    counts: DataFrame,
    window: int = WINDOW_BINS,
    alpha: float = EWMA_ALPHA,
    keys: Sequence[str] = ("org",),
) -> DataFrame:
    """z against the zero-filled window before a bin, and EWMA z, as closed bins arrive.

    Input are the closed bins of ``bin_counts_stream``, in order and one row per key and
    bin. State is a queue of one window of counts with its sums, and two moments per key.
    """
    keys = list(keys)
    alpha = min(max(alpha, EWMA_RANGE[0]), EWMA_RANGE[1])
    out = _merge(
        [counts.schema[k] for k in keys],
        {
            "bin": T.LongType(),
            "c": T.LongType(),
            "mean": T.DoubleType(),
            "std": T.DoubleType(),
            "z": T.DoubleType(),
            "ewma_z": T.DoubleType(),
        },
    )
    processor = keyed.DetectorProcessor(out.names, window, alpha, MIN_STD)
    return counts.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "None")


def rolling_stream(
    counts: DataFrame,
    window: str,
    slide: str,
    category: str = "source",
    keys: Sequence[str] = ("org",),
    delay: str = "10 seconds",
) -> DataFrame:
    """Count, distinct values and entropy of every sliding window, from closed bins.

    Input are the bins of ``bin_counts_stream`` by key and category.
    """
    per_value = (
        counts.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide).alias("w"), *keys, category)
        .agg(F.sum("c").alias("n"))
    )
    n = F.col("n")
    total = F.sum("n")
    out = per_value.groupBy("w", *keys).agg(
        total.alias("total"),
        F.count(F.lit(1)).alias("distinct_values"),
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy"),
    )
    return out.select(
        *keys, F.unix_seconds("w.end").alias("end_sec"), "total", "distinct_values", "entropy"
    )


def ordered_fold(
    events: DataFrame,
    keys: Sequence[str],
    value: Column,
    outputs: dict[str, T.DataType],
    step: keyed.Step,
    delay: str = "10 seconds",
    ttl: int | None = None,
    ts: str = "ts",
    order: str = "id",
) -> DataFrame:
    """Run ``step(memo, time, id, value)`` over each key's rows in event time.

    Rows wait in a list state until the watermark reaches them, which a timer tells. ``memo``
    is a list of whole numbers; with ``ttl`` a key without news for that many seconds is forgotten.
    """
    rows, out = _ordered(events, keys, value, outputs, delay, ts, order)
    processor = keyed.FoldProcessor(out.names, ttl, step)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def _ordered(
    events: DataFrame, keys: Sequence[str], value: Column, outputs: dict[str, T.DataType], delay: str, ts: str, order: str
) -> tuple[DataFrame, T.StructType]:
    """The rows an ordered processor reads, and the schema of what it makes.

    Names that begin with an underscore do not reach a stateful processor.
    """
    rows = events.withWatermark(ts, delay).select(
        *keys, ts, F.unix_micros(ts).alias("row_us"), F.col(order).cast("long").alias("row_id"),
        value.cast("long").alias("row_value"),
    )
    return rows, _merge([events.schema[k] for k in keys], {order: T.LongType(), "us": T.LongType(), **outputs})


def cooldown_stream(
    alerts: DataFrame, seconds: int = COOLDOWN_SECONDS, keys: Sequence[str] = ("org",), **kwargs
) -> DataFrame:
    """Alerts that come more than ``seconds`` after the last one sent."""
    gap = seconds * MICROS

    def step(memo, t, i, v):
        if memo and t <= memo[0] + gap:
            return memo, None
        return [t], ()

    return ordered_fold(alerts, keys, F.lit(0), {}, step, ttl=seconds, **kwargs)


def rate_limit_stream(
    fires: DataFrame,
    limit: int,
    keys: Sequence[str] = ("playbook_id",),
    seconds: int = RATE_WINDOW_SECONDS,
    **kwargs,
) -> DataFrame:
    """Flag the first ``limit`` fires of each window that opens at a fire."""
    span = seconds * MICROS

    def step(memo, t, i, v):
        opened, used = memo if memo and t <= memo[0] + span else (t, 0)
        ok = used < limit
        return [opened, used + ok], (bool(ok),)

    outputs = {"allowed": T.BooleanType()}
    return ordered_fold(fires, keys, F.lit(0), outputs, step, ttl=seconds, **kwargs)


def quota_stream(
    batches: DataFrame, limit: int, size: str = "size", keys: Sequence[str] = ("org", "day"), **kwargs
) -> DataFrame:
    """Accept batches whole while the day's total stays within the limit; a day is forgotten."""

    def step(memo, t, i, v):
        used = memo[0] if memo else 0
        ok = used + v <= limit
        return [used + v if ok else used], (bool(ok),)

    outputs = {"accepted": T.BooleanType()}
    return ordered_fold(batches, keys, F.col(size), outputs, step, ttl=86_400, **kwargs)


def service_health_stream(
    checks: DataFrame, failed: Column, keys: Sequence[str] = ("service",), **kwargs
) -> DataFrame:
    """Consecutive failures, status and alert after each health check."""

    def step(memo, t, i, bad):
        before = memo[0] if memo else 0
        n = before + 1 if bad else 0
        status = "healthy" if not bad else "unhealthy" if n >= FAILURE_THRESHOLD else "degraded"
        alert = None
        if bad:
            alert = {1: "warning", FAILURE_THRESHOLD: "critical"}.get(n)
        elif before >= FAILURE_THRESHOLD:
            alert = "resolved"
        return [n], (n, status, alert)

    outputs = {
        "consecutive_failures": T.LongType(),
        "status": T.StringType(),
        "alert": T.StringType(),
    }
    return ordered_fold(checks, keys, failed, outputs, step, **kwargs)


def correlate_stream(
    signals: DataFrame,
    rule_set: Sequence[rules.Rule] = rules.RULES,
    scale: int = 1,
    org: str = "org",
    delay: str = "10 seconds",
    ts: str = "ts",
    order: str = "id",
) -> DataFrame:
    """Incidents of all rules as signals arrive, one per run of matching signals.

    A signal is sent once to each kind of entity it names; all rules of a kind are folded
    together (``keyed.RulesProcessor``).
    """
    kinds: dict[str, list[rules.Rule]] = {}
    for rule in rule_set:
        kinds.setdefault(rule.entity, []).append(rule)
    entities, plans = [], {}
    for kind, members in kinds.items():
        bits, at = F.lit(0).cast("long"), 0
        plans[kind] = []
        for rule in members:
            plans[kind].append((rule.id, rule.span(scale), tuple(s.at_least for s in rule.stages), at))
            for stage in rule.stages:
                bits, at = bits + F.when(stage.matches(), 1 << at).otherwise(0), at + 1
        named = F.col(kind).isNotNull() & (F.col(kind) != "")
        entities.append(F.when(named, F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("entity_id"), bits.alias("bits"))))
    rows = signals.select(org, order, ts, F.explode(F.array_compact(F.array(*entities))).alias("e")).select(org, order, ts, "e.*")
    keys = [org, "kind", "entity_id"]
    long = T.LongType()
    outputs = {"rule_id": T.StringType(), "window_events": long, "matched_events": long, "first_seen": long}
    rows, out = _ordered(rows, keys, F.col("bits"), outputs, delay, ts, order)
    ttl = max(CORRELATION_TTL, *[-(-rule.span(scale) // MICROS) for rule in rule_set])
    found = rows.groupBy(*keys).transformWithStateInPandas(keyed.RulesProcessor(out.names, ttl, plans), out, "Append", "EventTime")
    severity = F.create_map(*[F.lit(x) for rule in rule_set for x in (rule.id, rule.severity)])
    return found.select(
        org,
        "rule_id",
        severity[F.col("rule_id")].alias("severity"),
        "entity_id",
        F.col(order).alias("trigger_id"),
        "window_events",
        "matched_events",
        "first_seen",
        F.col("us").alias("last_seen"),
    )


def correlate_batches(
    signals: DataFrame,
    path: str,
    delay: int,
    rule_set: Sequence[rules.Rule] = rules.RULES,
    scale: int = 1,
    org: str = "org",
    ts: str = "ts",
    order: str = "id",
    name: str = "correlate",
) -> None:
    """Incidents of all rules to ``path/incidents``, by the batch operator in every micro-batch.

    For many entities or hot ones: ``correlate_stream`` calls Python for every entity of a
    micro-batch and works on an entity in one task. State is a table of the signals that later ones
    can still see; ``path/signals`` has a folder per micro-batch, which a repeated batch replaces.
    The watermark is the newest time seen less ``delay`` seconds. Signals at or before it are closed;
    those that come after it has passed them are dropped.
    """
    # An incident asks for the window of the signal before, whose window is another span back.
    seen = 2 * max(rule.span(scale) for rule in rule_set)
    entities = {rule.entity for rule in rule_set}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(org, order, F.unix_micros(ts).alias("us"), "event_type", *sorted(entities)).filter("us is not null")
        before = None
        if number:
            known = spark.read.schema(rows.schema).parquet(f"{path}/signals/batch={number - 1}")
            before = _mark(known, delay)
            if before is not None:
                rows = known.filter(F.col("us") > before - seen).unionByName(rows.filter(F.col("us") > before))
        sinks.replace(rows, f"{path}/signals/batch={number}")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/signals/batch={number}")
        mark = _mark(rows, delay)
        # What has not happened yet changes nothing before it.
        found = rules.correlate(rows.filter(F.col("us") <= F.lit(mark).cast("long")), rule_set, scale, org, order=order)
        if before is not None:
            found = found.filter(F.col("last_seen") > before)
        sinks.replace(found, f"{path}/incidents/batch={number}")
        # A batch comes again at most until the next one begins.
        sinks.remove(spark, f"{path}/signals/batch={number - 2}")

    each_batch(signals, name, write)


def _mark(signals: DataFrame, delay: int) -> int | None:
    newest = signals.agg(F.max("us")).first()[0]
    return None if newest is None else newest - delay * MICROS


def ingest_stream(
    lines: DataFrame, path: str, now: Column, year: Column, order: str = "id", column: str = "line", name: str = "ingest"
) -> None:
    """Normalise and validate lines as they come: events to ``path/events``, the rest to ``path/quarantine``.

    Quarantined are events that break the schema, with what is wrong, and lines no event
    came from. Both places have a folder per micro-batch, which a repeated batch replaces, so
    that every line is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = normalize.normalize_logs(batch, now, year, column=column)
        epoch = (F.unix_micros("ts") / MICROS).alias("timestamp")
        checked = normalize.validate_schema(events.select("*", epoch)).drop("raw_data")
        sinks.replace(checked, f"{path}/checked/batch={number}")
        found = spark.read.schema(checked.schema).parquet(f"{path}/checked/batch={number}")
        sinks.replace(found.filter(F.size("errors") == 0).drop("errors"), f"{path}/events/batch={number}")
        broken = found.filter(F.size("errors") > 0).select(order, "parser", F.array_join("errors", "; ").alias("reason"))
        silent = batch.join(found.select(order), order, "left_anti").select(
            order, F.lit(None).cast("string").alias("parser"), F.when(_blank(column), EMPTY_LINE).otherwise(NO_EVENTS).alias("reason")
        )
        sinks.replace(broken.unionByName(silent), f"{path}/quarantine/batch={number}")

    each_batch(lines, name, write)


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) == "", F.lit(True))


def retention_stream(events: DataFrame, path: str, keep: int, delay: int, ts: str = "ts", name: str = "retention") -> None:
    """Store events by day and drop, after every micro-batch, what is ``keep`` seconds behind
    the watermark (the newest time stored less ``delay`` seconds)."""

    def write(batch: DataFrame, number: int) -> None:
        sinks.store_batch(batch, path, number, ts)
        cutoff = sinks.cutoff(batch.sparkSession, path, keep + delay, ts)
        if cutoff is not None:
            sinks.drop_expired(batch.sparkSession, path, cutoff, ts)

    each_batch(events, name, write)


def dedup_stream(
    alerts: DataFrame, keys: Sequence[str] = ("org", "sec"), delay: str = "10 seconds", ts: str = "ts"
) -> DataFrame:
    """First alert per key; keys are forgotten when the watermark has passed them."""
    return alerts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
