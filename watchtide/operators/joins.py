"""Joins of anomalies, incidents, users and versions, and the lists built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators import detect

RECENT_INCIDENTS = 50
ALERT_SECONDS = 120
DONE = ("Mitigated", "Acknowledged")


def latest_n(df: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.col(key).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def incidents_with_scores(
    incidents: DataFrame, anomalies: DataFrame, n: int = RECENT_INCIDENTS
) -> DataFrame:
    """The newest incidents with their anomaly's columns.

    An incident has at most one anomaly, so the newest are cut before the join.
    """
    newest = latest_n(incidents, "created_at", n, "id")
    scores = anomalies.withColumnRenamed("id", "anomaly_id")
    return newest.join(scores, "anomaly_id", "left")


def pending_alerts(
    anomalies: DataFrame, incidents: DataFrame, since: int = 0, now: Column | None = None
) -> DataFrame:
    """Anomalies after ``since``, or the open ones of the last two minutes, with incident ids."""
    if since > 0:
        rows = anomalies.filter(F.col("id") > since)
    else:
        rows = anomalies.filter(
            ~F.col("status").isin(*DONE) & (F.col("timestamp") >= now - ALERT_SECONDS)
        )
    ids = incidents.select(F.col("id").alias("incident_id"), F.col("anomaly_id").alias("id"))
    return rows.join(ids, "id", "left")


def orphan_anomalies(anomalies: DataFrame, incidents: DataFrame) -> DataFrame:
    """An incident row for each anomaly that has none."""
    alone = anomalies.join(
        incidents.select(F.col("anomaly_id").alias("id")), "id", "left_anti"
    )
    method = F.coalesce("detection_method", F.lit("ZSCORE"))
    level = F.coalesce("severity", F.lit("MEDIUM"))
    return alone.select(
        F.col("id").alias("anomaly_id"),
        detect.detection_title(F.col("id"), method, level).alias("title"),
        detect.detection_summary(
            F.col("event_count"),
            F.col("z_score"),
            F.col("iforest_score"),
            F.col("ewma_score"),
            F.col("hybrid_score"),
            method,
        ).alias("description"),
        level.alias("severity"),
        F.lit("OPEN").alias("status"),
    )


NO_DIAGNOSIS = "Analyzed by AI agent — no detailed diagnosis available."


def _shown(number: Column, default: str) -> Column:
    """A number as short text; missing and zero show the default."""
    text = F.regexp_replace(number.cast("string"), r"\.0$", "")
    return F.when(number != 0, text).otherwise(F.lit(default))


def backfill_empty(incidents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Fill the diagnosis columns of incidents that lack a cause or an action."""

    def empty(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    facts = anomalies.select(
        F.col("id").alias("anomaly_id"),
        F.col("diagnosis").alias("_diagnosis"),
        F.col("z_score").alias("_z"),
        F.col("event_count").alias("_n"),
        F.col("severity").alias("_level"),
    )
    todo = (empty("root_cause") | empty("recommended_action")) & F.col("anomaly_id").isNotNull()
    z = _shown(F.col("_z"), "N/A")
    filled = {
        "root_cause": F.concat(
            F.lit("Traffic anomaly detected (Z-Score: "),
            z,
            F.lit(", "),
            _shown(F.col("_n"), "0"),
            F.lit(" events/sec, severity: "),
            F.coalesce(F.nullif("_level", F.lit("")), F.lit("MEDIUM")),
            F.lit(")"),
        ),
        "ai_diagnosis": F.coalesce(F.nullif("_diagnosis", F.lit("")), F.lit(NO_DIAGNOSIS)),
        "resolution": F.when(
            F.col("status") == "MITIGATED", "Automated containment applied."
        ).otherwise("Pending analyst review."),
        "recommended_action": F.concat(
            F.lit("Investigate the traffic anomaly (Z-Score: "),
            z,
            F.lit(
                ") and review system logs for potential issues. Verify source distribution and "
                "check if any ongoing campaigns or attacks are contributing to this anomaly."
            ),
        ),
    }
    out = incidents.join(facts, "anomaly_id", "left").withColumn("_todo", todo)
    return out.withColumns(
        {c: F.when(F.col("_todo"), v).otherwise(F.col(c)) for c, v in filled.items()}
    ).drop("_diagnosis", "_z", "_n", "_level", "_todo")


def audit_with_user(
    audit: DataFrame, users: DataFrame, org, n: int, time: str = "created_at"
) -> DataFrame:
    """An organisation's newest audit rows with their users; cut before the join."""
    newest = latest_n(audit.filter(F.col("org") == F.lit(org)), time, n, "id")
    return newest.join(users, "user_id", "left")


def _latest_by(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    row = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("r"))
    return row.select(*keys, "r.*").select(*df.columns)


def latest_version(prompts: DataFrame, keys: Sequence[str] = ("org", "name")) -> DataFrame:
    """The active version of each prompt, or its last one."""
    return _latest_by(prompts, keys, F.struct("is_active", "version"))


def active_versions(prompts: DataFrame, keys: Sequence[str] = ("org", "name")) -> DataFrame:
    return latest_version(prompts.filter("is_active"), keys)


def rollback_version(
    prompts: DataFrame, keys: Sequence[str], chosen: Column, target: int
) -> DataFrame:
    """Append a copy of version ``target`` as the only active one of the chosen prompts.

    Prompts without that version are left as they are.
    """
    has = prompts.filter(chosen & (F.col("version") == target)).select(*keys).distinct()
    has = has.withColumn("_has", F.lit(True))
    marked = prompts.join(has, list(keys), "left")
    kept = marked.withColumn(
        "is_active", F.col("is_active") & F.col("_has").isNull()
    ).drop("_has")
    last = marked.filter("_has").groupBy(*keys).agg(F.max("version").alias("_last"))
    copy = (
        prompts.filter(F.col("version") == target)
        .join(last, list(keys))
        .withColumns({"version": F.col("_last") + 1, "is_active": F.lit(True)})
        .drop("_last")
    )
    return kept.unionByName(copy.withColumn("version", F.col("version").cast(prompts.schema["version"].dataType)))


def agent_trace(steps: DataFrame, anomaly: str, step: str, ident: str) -> DataFrame:
    """The steps of the latest anomaly that has any, in order."""
    latest = steps.agg(F.max(anomaly)).scalar()
    return steps.filter(F.col(anomaly) == latest).orderBy(step, ident)


def first_matching(df: DataFrame, id_col: str, condition: Column) -> DataFrame:
    """The row with the lowest id that satisfies a condition."""
    lowest = df.filter(condition).agg(F.min(id_col)).scalar()
    return df.filter(F.col(id_col) == lowest)
