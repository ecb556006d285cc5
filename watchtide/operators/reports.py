"""Operational reports: counts, service levels, latency, cost, reliability and usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.functions.scoring import CLOSED, half_up, sla_breached, sla_deadline
from watchtide.operators import slices

MICROS = 1_000_000


def tenant_filter(df: DataFrame, org, role: str = "analyst", column: str = "org") -> DataFrame:
    """Rows of one organisation; the super administrator sees all."""
    return df if role == "super_admin" else df.filter(F.col(column) == F.lit(org))


def tenant_or_global(df: DataFrame, org, column: str = "org") -> DataFrame:
    """Rows of one organisation and those that belong to none."""
    return df.filter((F.col(column) == F.lit(org)) | F.col(column).isNull())


def recent(df: DataFrame, now: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """Rows of the last seconds; the bare column keeps the comparison pushable."""
    return df.filter(F.col(ts) >= slices.stored_time(df, ts, now - F.make_dt_interval(secs=F.lit(seconds))))


def events_in_last(df: DataFrame, now: Column, seconds: int = 60, ts: str = "ts") -> DataFrame:
    return recent(df, now, seconds, ts).agg(F.count(F.lit(1)).alias("events"))


def top_counts(
    df: DataFrame, column: str, now: Column, seconds: int, top: int | None = None, ts: str = "ts"
) -> DataFrame:
    """Counts by value over the last seconds, most first, ties by value."""
    out = recent(df, now, seconds, ts).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.col("n").desc(), column)
    return out if top is None else out.limit(top)


def status_banner(anomalies: DataFrame, now: Column) -> DataFrame:
    """Breach within 15 seconds of the latest anomaly, mitigating while it is pending."""
    latest = anomalies.agg(
        F.max_by(F.struct("timestamp", "status"), "id").alias("a")
    ).select("a.timestamp", "a.status")
    banner = (
        F.when(now - F.col("timestamp") < 15, "BREACH DETECTED")
        .when(F.col("status") == "Pending Mitigation", "AGENT MITIGATING")
        .otherwise("Steady State")
    )
    return latest.select(banner.alias("banner"))


def incident_stats(incidents: DataFrame, open_status: str = "OPEN") -> DataFrame:
    def count(test: Column) -> Column:
        return F.count_if(test)

    return incidents.agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("status") == open_status).alias("open_count"),
        count(F.col("severity") == "CRITICAL").alias("critical_count"),
    )


def threat_statistics(anomalies: DataFrame, mitigated: str = "Mitigated") -> DataFrame:
    done = F.count_if(F.col("status") == mitigated)
    return anomalies.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        done.alias("mitigated"),
        (F.count(F.lit(1)) - done).alias("pending"),
    )


# Categories always shown and the value missing entries count as.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
METHODS = ("ZSCORE", "ZSCORE+EWMA", "HYBRID")


def fixed_distribution(
    df: DataFrame, column: str, values: Sequence[str], missing: str
) -> DataFrame:
    """Count of each listed value, 0 where there is none, from one pass."""
    value = F.coalesce(F.nullif(column, F.lit("")), F.lit(missing))
    counts = df.agg(*[F.count_if(value == v).alias(f"_{i}") for i, v in enumerate(values)])
    rows = F.array(
        *[F.struct(F.lit(v).alias(column), F.col(f"_{i}").alias("n")) for i, v in enumerate(values)]
    )
    return counts.select(F.inline(rows))


def severity_distribution(df: DataFrame) -> DataFrame:
    return fixed_distribution(df, "severity", SEVERITIES, "MEDIUM")


def method_distribution(df: DataFrame) -> DataFrame:
    return fixed_distribution(df, "detection_method", METHODS, "ZSCORE")


def case_status_counts(cases: DataFrame) -> DataFrame:
    status = F.col("status")
    return cases.agg(
        F.count_if(status.isin("open", "assigned")).alias("open_cases"),
        F.count_if(status == "investigating").alias("investigating_cases"),
        F.count_if(status.isin(*CLOSED)).alias("closed_cases"),
    )


def with_sla(cases: DataFrame, now: Column) -> DataFrame:
    """Add the deadline in epoch seconds and whether it is breached."""
    out = cases.withColumn("sla_deadline", sla_deadline(F.col("created_sec"), F.col("severity")))
    return out.withColumn(
        "sla_breached", sla_breached(F.col("sla_deadline"), F.col("status"), now)
    )


def case_list(
    cases: DataFrame,
    now: Column,
    status: str | None = None,
    severity: str | None = None,
    assigned_to=None,
    breached: bool | None = None,
) -> DataFrame:
    """Cases by optional filters, newest first; breaches are worked out before the filter."""
    out = with_sla(cases, now)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    if assigned_to is not None:
        out = out.filter(F.col("assigned_to") == F.lit(assigned_to))
    if breached is not None:
        out = out.filter(F.col("sla_breached") == breached)
    return out.orderBy(F.col("created_sec").desc(), F.col("id").desc())


def sla_status(cases: DataFrame, now: Column) -> DataFrame:
    """Active cases: total, breached and within an hour of the deadline."""
    active = with_sla(cases, now).filter(~F.col("status").isin(*CLOSED))
    deadline = F.col("sla_deadline")
    return active.agg(
        F.count(F.lit(1)).alias("total_active"),
        F.count_if(now > deadline).alias("breached"),
        F.count_if((now > deadline - 3600) & (now <= deadline)).alias("approaching"),
    )


def sla_by_severity(cases: DataFrame, now: Column) -> DataFrame:
    """Active and breached cases of every severity, zero included."""
    active = with_sla(cases, now).filter(~F.col("status").isin(*CLOSED))
    level, late = F.col("severity"), now > F.col("sla_deadline")
    counts = active.agg(
        *[F.count_if(level == s).alias(f"t{i}") for i, s in enumerate(SEVERITIES)],
        *[F.count_if((level == s) & late).alias(f"b{i}") for i, s in enumerate(SEVERITIES)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("severity"),
                F.col(f"t{i}").alias("total"),
                F.col(f"b{i}").alias("breached"),
            )
            for i, s in enumerate(SEVERITIES)
        ]
    )
    return counts.select(F.inline(rows))


def ordered_bits(value: str, kind: T.DataType) -> Column:
    """A whole number that sorts as the value does; for doubles their bits, negative ones turned over."""
    if isinstance(kind, T.IntegralType):
        return F.col(value).cast("long")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double")).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR((1 << 63) - 1)).otherwise(bits)


def nearest_rank(df: DataFrame, value: str, p: float, keys: Sequence[str]) -> DataFrame:
    """The exact value at rank ceil(p n) of every key, and n; null values do not count.

    Rows are counted by value once. Four histograms of 16 bits each then narrow down, for
    every key, the range of values that holds the rank: from one to the next only the chosen
    range is looked at, with the rank inside it, so nothing is assumed about how values
    are spread and no key is sorted or held as a whole.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    bits = ordered_bits(value, df.schema[value].dataType)
    left = counted.withColumn("_bits", bits)
    chosen: list[str] = []
    found = None
    for level, shift in enumerate((48, 32, 16, 0)):
        part = F.shiftright("_bits", shift)
        name = f"_b{level}"
        left = left.withColumn(name, part if level == 0 else part.bitwiseAND(0xFFFF))
        rows = left if found is None else left.join(found, [*keys, *chosen])
        counts = rows.groupBy(*keys, *chosen, name).agg(
            F.sum("_c").alias("_c"), F.min(value).alias("percentile"), *([] if found is None else [F.max("_need").alias("_need"), F.max("n").alias("n")])
        )
        whole = Window.partitionBy(*keys)
        counts = counts.withColumn("_upto", F.sum("_c").over(whole.orderBy(name)))
        if found is None:
            counts = counts.withColumn("n", F.sum("_c").over(whole))
            counts = counts.withColumn("_need", F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)))
        chosen.append(name)
        at = counts.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_c") < F.col("_need")))
        found = at.select(*keys, *chosen, (F.col("_need") - (F.col("_upto") - F.col("_c"))).alias("_need"), "n", "percentile")
        if level < 3:
            found = found.drop("percentile")
    return found.select(*keys, "percentile", "n")


def latency_dashboard(
    metrics: DataFrame, now: Column, hours: int = 24, p: float = 0.95, keys: Sequence[str] = ("type",)
) -> DataFrame:
    """Mean, exact nearest-rank percentile, count and error rate per type over the last hours."""
    last = metrics.filter(F.col("ts") > slices.stored_time(metrics, "ts", now - F.make_dt_interval(hours=F.lit(hours))))
    basic = last.groupBy(*keys).agg(
        F.avg("value").alias("avg_latency"),
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.when(~F.col("success"), 1.0).otherwise(0.0)).alias("error_rate"),
    )
    rank = nearest_rank(last, "value", p, keys).select(
        *keys, F.col("percentile").alias("p95_latency")
    )
    return basic.join(rank, list(keys), "left")


def rag_success_rate(metrics: DataFrame) -> DataFrame:
    """Share of retrievals that found something and mean number of sources."""
    return metrics.agg(
        F.coalesce(F.avg(F.when(F.col("sources_found") > 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias(
            "success_rate"
        ),
        F.coalesce(F.avg("sources_found"), F.lit(0.0)).alias("avg_sources"),
    )


# Price of a thousand tokens in and out.
INPUT_PRICE = 0.000125
OUTPUT_PRICE = 0.000375


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1000 * INPUT_PRICE + tokens_out / 1000 * OUTPUT_PRICE


def cost_rollup(usage: DataFrame, keys: Sequence[str] = ("tenant", "day", "model")) -> DataFrame:
    """Tokens, cost and requests; cost follows from the summed whole token counts."""
    out = usage.groupBy(*keys).agg(
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.count(F.lit(1)).alias("requests"),
    )
    return out.withColumns(
        {
            "total_tokens": F.col("tokens_in") + F.col("tokens_out"),
            "cost_usd": token_cost(F.col("tokens_in"), F.col("tokens_out")),
        }
    )


def cost_report(rollup: DataFrame, start: Column, end: Column, tenant=None) -> DataFrame:
    """Rollup rows between two days, both included."""
    rows = rollup.filter(F.col("day").between(start, end))
    return rows if tenant is None else rows.filter(F.col("tenant") == F.lit(tenant))


def cost_by_model(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("model").agg(
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("requests").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def cost_summary(rollup: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Totals of today, of the last days and of all time, one row."""
    is_today = F.col("day") == today
    is_month = F.col("day") >= F.date_sub(today, days)

    def total(column: str, test: Column | None, name: str) -> Column:
        value = F.col(column) if test is None else F.when(test, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    aggs = []
    for column in ("tokens_in", "tokens_out", "cost_usd"):
        aggs.append(total(column, is_today, f"today_{column}"))
        aggs.append(total(column, is_month, f"month_{column}"))
        aggs.append(total(column, None, f"total_{column}"))
    return rollup.agg(*aggs, total("requests", None, "total_requests"))


def reliability_metrics(
    logs: DataFrame, since: Column, keys: Sequence[str] = ("tenant",), tenants: DataFrame | None = None
) -> DataFrame:
    """Requests, mean truth, hallucination and fallback rates, latency and tokens since a time.

    With ``tenants`` given, those without requests appear with the defaults.
    """
    rows = logs.filter(F.col("request_timestamp") >= since)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg("truth_score").alias("mean_truth_score"),
        F.avg(F.when(F.col("outcome") == "HALLUCINATION_DETECTED", 1.0).otherwise(0.0)).alias(
            "hallucination_rate"
        ),
        F.avg(F.when(F.col("safe_fallback_used") == 1, 1.0).otherwise(0.0)).alias("fallback_rate"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum(F.col("tokens_input") + F.col("tokens_output")).alias("total_tokens"),
    )
    if tenants is not None:
        out = tenants.join(out, list(keys), "left")
    empty = {
        "total_requests": 0,
        "mean_truth_score": 1.0,
        "hallucination_rate": 0.0,
        "fallback_rate": 0.0,
        "avg_latency_ms": 0.0,
        "total_tokens": 0,
    }
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in empty.items()})


# Report metrics, the change that counts as a trend, and advice.
REPORT_METRICS = (
    "citation_quality",
    "hallucination_score",
    "consistency_score",
    "accuracy_score",
    "retrieval_score",
    "overall_score",
)
TREND_STEP = 0.05
ADVICE = (
    (
        "citation_quality",
        "<",
        0.5,
        "Improve source citation practices — prompt the AI to explicitly reference retrieved documents",
    ),
    (
        "hallucination_score",
        ">",
        0.3,
        "High hallucination rate detected — consider lowering RAG confidence threshold or adding "
        "more knowledge base documents",
    ),
    (
        "retrieval_score",
        "<",
        0.4,
        "Retrieval effectiveness is low — review Qdrant collection content and consider "
        "re-indexing with better metadata",
    ),
)
NO_ADVICE = "AI performance metrics are within acceptable ranges. Continue monitoring."


def evaluation_report(
    evaluations: DataFrame,
    start_us: int,
    end_us: int,
    keys: Sequence[str] = ("tenant",),
    us: str = "us",
    order: str = "id",
    slice_us: int = 86_400 * MICROS,
) -> DataFrame:
    """Averages, trends of the second half of the rows against the first, and advice."""
    rows = evaluations.filter(F.col(us).between(start_us, end_us))
    rows = slices.numbered(rows, keys, us, order, slice_us)
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    trends = ("citation_quality", "hallucination_score", "overall_score")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_interactions"),
        *[F.avg(m).alias(m) for m in REPORT_METRICS],
        *[F.avg(F.when(first, F.col(m))).alias(f"_a_{m}") for m in trends],
        *[F.avg(F.when(~first, F.col(m))).alias(f"_b_{m}") for m in trends],
    )

    def trend(m: str) -> Column:
        diff = F.col(f"_b_{m}") - F.col(f"_a_{m}")
        better = diff < 0 if m == "hallucination_score" else diff > 0
        steady = diff.isNull() | (F.abs(diff) < TREND_STEP)
        return F.when(steady, "stable").when(better, "improving").otherwise("declining")

    out = out.withColumns({f"{m}_trend": trend(m) for m in trends})
    notes = F.concat_ws(
        " | ",
        *[
            F.when(F.col(m) < limit if op == "<" else F.col(m) > limit, F.lit(text))
            for m, op, limit, text in ADVICE
        ],
    )
    out = out.withColumn(
        "recommendations", F.coalesce(F.nullif(notes, F.lit("")), F.lit(NO_ADVICE))
    )
    out = out.drop(*[f"_{h}_{m}" for h in "ab" for m in trends])
    return out.withColumns({m: half_up(F.col(m)) for m in REPORT_METRICS})


# Events a plan allows per day; none is unlimited.
PLAN_EVENTS = {"starter": 10_000, "pro": 1_000_000, "enterprise": None}


def tenant_usage(
    events: DataFrame, plan: str = "starter", keys: Sequence[str] = ("org",), ts: str = "ts"
) -> DataFrame:
    """Events per tenant and day and the share of the plan used, at most 100 percent."""
    limit = PLAN_EVENTS.get(plan, PLAN_EVENTS["starter"])
    out = events.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("events_today")
    )
    if limit is None:
        return out.withColumns(
            {"events_limit": F.lit(None).cast("long"), "percentage": F.lit(0).cast("long")}
        )
    share = F.floor(F.col("events_today") / limit * 100 + 0.5).cast("long")
    return out.withColumns(
        {
            "events_limit": F.lit(limit).cast("long"),
            "percentage": F.least(F.lit(100).cast("long"), share),
        }
    )


def org_user_counts(orgs: DataFrame, users: DataFrame, key: str, user: str) -> DataFrame:
    """Users of every organisation, none counted as 0; users are counted before the join."""
    counted = users.groupBy(key).agg(F.count(user).alias("users"))
    return orgs.join(counted, key, "left").withColumn("users", F.coalesce("users", F.lit(0)))


# Words an ad-hoc query may not contain.
FORBIDDEN_WORDS = (
    "drop",
    "delete",
    "update",
    "insert",
    "alter",
    "create",
    "replace",
    "attach",
    "pragma",
)


def guarded_sql(spark, text: str) -> DataFrame:
    """Run one read-only SELECT over registered views; anything else is refused."""
    import re

    clean = text.strip()
    if ";" in clean:
        raise ValueError("stacked queries and semicolons are not allowed")
    low = clean.lower()
    for word in FORBIDDEN_WORDS:
        if re.search(rf"\b{word}\b", low):
            raise ValueError(f"forbidden keyword '{word.upper()}'")
    if not low.startswith("select"):
        raise ValueError("only read-only SELECT statements are accepted")
    return spark.sql(clean)
