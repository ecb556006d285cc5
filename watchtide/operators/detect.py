"""Fusion, severity, breaches and threat classes over detector series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.text import fixed
from watchtide.operators import series as bins
from watchtide.operators import slices

# Weights of z-score, isolation forest and EWMA with a trained forest, and of
# z-score and EWMA without one.
FUSION_TRAINED = (0.35, 0.40, 0.25)
FUSION_UNTRAINED = (0.6, 0.4)
EWMA_FULL_SCALE = 6.0
MIN_BREACH_RATE = 5
HYBRID_BREACH = 0.3
METHOD_TRAINED = "HYBRID"
METHOD_UNTRAINED = "ZSCORE+EWMA"

# Keyword families looked for in lower-cased type, source and id.
BRUTE_FORCE_WORDS = ("fail", "auth", "login", "brute")
EXFILTRATION_WORDS = ("exfil", "transfer", "outbound", "export", "download")
INSIDER_WORDS = ("privileged", "config", "admin", "policy", "sensitive", "insider")
SERVICE_WORDS = ("heartbeat", "drop", "miss", "failure", "inactive", "service_fail")

# Classes with their confidence and advice.
BRUTE_FORCE = (
    "Possible Brute Force Activity",
    82.0,
    "Review authentication logs and lock affected accounts.",
)
SERVICE_FAILURE = (
    "Possible Service Failure",
    74.0,
    "Investigate infrastructure health and service availability.",
)
EXFILTRATION = (
    "Possible Data Exfiltration",
    71.0,
    "Review outbound traffic and investigate affected systems.",
)
INSIDER = (
    "Possible Insider Threat",
    69.0,
    "Audit privileged access and investigate user activity.",
)
DDOS = (
    "Possible DDoS Activity",
    76.0,
    "Review network traffic and enable mitigation controls.",
)
DDOS_WEAK_CONFIDENCE = 65.0


def hybrid_score(
    z: Column, ewma_z: Column, iforest: Column | None = None, threshold: float = bins.THRESHOLD
) -> Column:
    """Fuse the scores; a negative z lowers the result, there is no floor."""
    zn = F.least(z / F.lit(threshold * 3), F.lit(1.0))
    en = F.least(F.abs(ewma_z) / F.lit(EWMA_FULL_SCALE), F.lit(1.0))
    if iforest is None:
        wz, we = FUSION_UNTRAINED
        return wz * zn + we * en
    wz, wi, we = FUSION_TRAINED
    return wz * zn + wi * iforest + we * en


def detection_method(trained: bool) -> Column:
    return F.lit(METHOD_TRAINED if trained else METHOD_UNTRAINED)


def severity(hybrid: Column) -> Column:
    return (
        F.when(hybrid >= 0.7, "CRITICAL")
        .when(hybrid >= 0.5, "HIGH")
        .when(hybrid >= 0.3, "MEDIUM")
        .otherwise("LOW")
    )


def severity_z(z: Column, threshold: float = bins.THRESHOLD) -> Column:
    return (
        F.when(z > threshold * 2, "CRITICAL")
        .when(z > threshold * 1.5, "HIGH")
        .when(z > threshold, "MEDIUM")
        .otherwise("LOW")
    )


def is_breach(
    rate: Column, z: Column, hybrid: Column | None = None, threshold: float = bins.THRESHOLD
) -> Column:
    hit = z > threshold
    if hybrid is not None:
        hit = hit | (hybrid >= HYBRID_BREACH)
    return hit & (rate > MIN_BREACH_RATE)


def breaches(
    df: DataFrame,
    window: int = bins.WINDOW_BINS,
    seconds: int = 1,
    threshold: float = bins.THRESHOLD,
    keys: Sequence[str] = ("org",),
) -> DataFrame:
    """Bins of the event stream that breach on their z-score."""
    scored = bins.zscore(bins.bin_counts(df, seconds, keys), window, keys)
    return scored.filter(is_breach(F.col("c"), F.col("z"), None, threshold)).withColumn(
        "severity", severity_z(F.col("z"), threshold)
    )


def alert_dedup(
    alerts: DataFrame, existing: DataFrame | None, keys: Sequence[str] = ("org", "sec"), order: str = "id"
) -> DataFrame:
    """At most one alert per key and second, none where one is already stored."""
    if existing is not None:
        alerts = alerts.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    cols = [c for c in alerts.columns if c not in keys]
    first = alerts.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("row"))
    return first.select(*keys, "row.*").select(*alerts.columns)


def _has(words: Sequence[str], *columns: Column) -> Column:
    hit = F.lit(False)
    for col in columns:
        hit = hit | col.rlike("|".join(words))
    return hit


def threat_flags(event_type: str = "event_type", source: str = "source", ident: str = "id") -> dict[str, Column]:
    """The four keyword tests of one event as 0/1 columns."""
    kind, src, ref = (
        F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (event_type, source, ident)
    )
    failed = _has(BRUTE_FORCE_WORDS, kind, src, ref) & (
        kind.contains("fail") | ref.contains("fail") | kind.contains("brute")
    )
    tests = {
        "failed_logins": failed,
        "large_transfers": _has(EXFILTRATION_WORDS, kind, src, ref),
        "privileged_actions": _has(INSIDER_WORDS, kind, src, ref),
        "service_drops": _has(SERVICE_WORDS, kind, src, ref),
    }
    return {n: t.cast("long") for n, t in tests.items()}


def log_table_flags() -> dict[str, Column]:
    """The same four tests for rows of the stacked log tables, by ``table_name``."""
    table, status = F.col("table_name"), F.col("status")
    failed = table.isin("authentication_logs", "vpn_logs") & (status == "failed")
    moved = (table == "network_events") & (
        (F.col("event_type") == "data_transfer") | (F.col("amount") > 1_000_000)
    )
    privileged = (table == "application_logs") & (
        (F.col("severity_level") == "CRITICAL")
        | F.col("user_name").isin("admin", "superadmin")
        | (F.col("event_type") == "privileged_action")
    )
    tests = {
        "failed_logins": failed,
        "large_transfers": moved,
        "privileged_actions": privileged,
        "service_drops": F.lit(False),
    }
    return {n: F.coalesce(t, F.lit(False)).cast("long") for n, t in tests.items()}


def indicator_counts(
    df: DataFrame,
    window: int = bins.WINDOW_BINS,
    seconds: int = 1,
    keys: Sequence[str] = ("org",),
    flags: dict[str, Column] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Per bin its count and the four keyword counts of the bins back to ``bin - window``."""
    flags = flags or threat_flags()
    per_bin = (
        df.select(*keys, bins.bin_of(ts, seconds).alias("bin"), *[c.alias(n) for n, c in flags.items()])
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("c"), *[F.sum(n).alias(n) for n in flags])
    )
    return slices.sliding(per_bin, keys, "bin", {n: (F.sum(n), -window, 0) for n in flags})


def classify_threat(df: DataFrame, count: str = "c", z: str = "z") -> DataFrame:
    """Name the likely threat from the four indicator counts, the bin count and z."""
    c, zc = F.col(count), F.col(z)
    cases = [
        (F.col("failed_logins") >= 10, BRUTE_FORCE),
        ((F.col("service_drops") > 0) | (c <= 2), SERVICE_FAILURE),
        (F.col("large_transfers") > 0, EXFILTRATION),
        (F.col("privileged_actions") > 0, INSIDER),
        ((c >= 10) | (zc > 3.0), DDOS),
    ]
    weak = (DDOS[0], DDOS_WEAK_CONFIDENCE, DDOS[2])

    def pick(i: int) -> Column:
        out = F
        for test, values in cases:
            out = out.when(test, F.lit(values[i]))
        return out.otherwise(F.lit(weak[i]))

    return df.withColumns(
        {"possible_threat": pick(0), "threat_confidence": pick(1), "recommendation": pick(2)}
    )


# Modules in their order.
MODULES = ("Rule Engine", "Isolation Forest", "Behavioral Engine", "Risk Engine")


def module_scores(
    event_type: Column,
    burst_ratio: Column,
    entropy: Column,
    asset_multiplier: Column,
    iforest: Column | None = None,
    enabled: Sequence[str] = MODULES,
) -> Column:
    """Array of (module, score) for the enabled modules; a module without input scores 0."""
    scores = {
        "Rule Engine": F.when(event_type == "failed_login", 0.4)
        .when((event_type == "brute_force") | (burst_ratio > 5.0), 0.9)
        .otherwise(0.0),
        "Isolation Forest": F.lit(0.0) if iforest is None else iforest,
        "Behavioral Engine": F.when(entropy < 1.0, 0.7).otherwise(0.0),
        "Risk Engine": F.when(asset_multiplier > 1.5, 0.8).otherwise(0.2),
    }
    rows = [
        F.struct(F.lit(m).alias("module"), F.coalesce(scores[m], F.lit(0.0)).alias("score"))
        for m in MODULES
        if m in enabled
    ]
    return F.array(*rows)


def detection_title(alert_id: Column, method: Column, level: Column) -> Column:
    return F.format_string("[%s] %s Severity Anomaly Breach #%d", method, level, alert_id)


def detection_summary(count: Column, z: Column, iforest: Column, ewma: Column, hybrid: Column, method: Column) -> Column:
    def shown(c: Column, digits: int) -> Column:
        return fixed(F.coalesce(c.cast("double"), F.lit(0.0)), digits)

    return F.format_string(
        "%s detection triggered at %d events/sec. Z-Score=%s, iForest=%s, EWMA=%s, Hybrid=%s.",
        method,
        count,
        shown(z, 2),
        shown(iforest, 3),
        shown(ewma, 2),
        shown(hybrid, 3),
    )
