"""Exports, appends, upserts and retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns each export has, in order, with their headings.
EXPORT_COLUMNS = {
    "anomalies": {
        "ID": "id",
        "Timestamp": "timestamp",
        "Z-Score": "z_score",
        "iForest Score": "iforest_score",
        "EWMA Score": "ewma_score",
        "Hybrid Score": "hybrid_score",
        "Hybrid Severity": "hybrid_severity",
        "Detection Method": "detection_method",
        "Event Count": "event_count",
        "Source Entropy": "source_entropy",
        "Burst Ratio": "burst_ratio",
        "Status": "status",
        "Severity": "severity",
        "Diagnosis": "diagnosis",
    },
    "incidents": {
        "ID": "id",
        "Title": "title",
        "Status": "status",
        "Severity": "severity",
        "Detection Method": "detection_method",
        "Z-Score": "z_score",
        "iForest": "iforest_score",
        "Hybrid Score": "hybrid_score",
        "Anomaly ID": "anomaly_id",
        "Detection Time": "detection_time",
        "Root Cause": "root_cause",
        "AI Diagnosis": "ai_diagnosis",
        "Resolution": "resolution",
        "Recommended Action": "recommended_action",
    },
    "audit": {
        "ID": "id",
        "User ID": "user_id",
        "Username": "username",
        "Action": "action",
        "Resource": "resource",
        "Details": "details",
        "Timestamp": "timestamp",
        "IP Address": "ip_address",
    },
}
# Days or seconds kept.
RETENTION_SECONDS = {"events": 600, "anomalies": 180 * 86_400, "incidents": 365 * 86_400}


def iso_time(epoch: Column) -> Column:
    """Epoch seconds as ISO text with milliseconds in UTC."""
    return F.date_format(
        F.timestamp_millis(F.floor(epoch * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )


def _newest(df: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    """All rows, newest first, or the newest ``limit``."""
    rows = df.orderBy(F.col(id_col).desc())
    return rows if limit is None else rows.limit(limit)


def export_rows(df: DataFrame, dataset: str, limit: int | None = None) -> DataFrame:
    """The newest rows by id in the export's columns; columns the data lacks are empty."""
    have = set(df.columns)
    cols = []
    for heading, name in EXPORT_COLUMNS[dataset].items():
        value = F.col(name) if name in have else F.lit(None).cast("string")
        if name in ("timestamp", "detection_time") and name in have:
            value = iso_time(value)
        cols.append(value.alias(heading))
    return _newest(df, "id", limit).select(*cols)


def export_csv(df: DataFrame, dataset: str, path: str, limit: int | None = None) -> None:
    rows = export_rows(df, dataset, limit)
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)


def report_summary(events: DataFrame, anomalies: DataFrame, incidents: DataFrame) -> DataFrame:
    """The counts at the head of a full report, one row."""

    def n(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return events.agg(F.count(F.lit(1)).alias("total_events")).select(
        "total_events",
        n(anomalies).alias("total_anomalies"),
        n(incidents).alias("total_incidents"),
    )


def json_rows(df: DataFrame, id_col: str = "id", limit: int | None = None) -> DataFrame:
    """The newest rows as one JSON text each."""
    cols = sorted(df.columns)
    return _newest(df, id_col, limit).select(F.col(id_col), F.to_json(F.struct(*cols)).alias("json"))


def export_json(df: DataFrame, path: str, limit: int | None = None) -> None:
    _newest(df, "id", limit).write.mode("overwrite").json(path)


def storable_events(df: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """Add the partition date; ``most`` clips text columns to so many characters."""
    clipped = {name: F.substring(name, 1, size) for name, size in (most or {}).items()}
    return df.withColumns({**clipped, "event_date": F.to_date("ts")})


def append_events(df: DataFrame, path: str, most: dict[str, int] | None = None) -> None:
    """Append events, one folder per organisation and day."""
    storable_events(df, most).write.mode("append").partitionBy("org", "event_date").parquet(path)


def upsert_points(
    existing: DataFrame, batch: DataFrame, id_col: str = "id", seq: str = "seq"
) -> DataFrame:
    """Insert or replace by id; the row with the highest ``seq`` wins, the batch on ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    cols = [c for c in existing.columns if c != id_col]
    last = both.groupBy(id_col).agg(
        F.max_by(F.struct(*cols), F.struct("_new", seq)).alias("row")
    )
    return last.select(id_col, "row.*").select(*existing.columns)


def prune(df: DataFrame, ts: str, now: Column, seconds: int) -> DataFrame:
    """Rows still inside their retention; the bare column keeps the comparison pushable."""
    return df.filter(F.col(ts) >= (now - F.make_dt_interval(secs=F.lit(seconds))).cast(df.schema[ts].dataType))


def delete_by_payload(df: DataFrame, column: str, value) -> DataFrame:
    """Drop matching points; rows without the field stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Rewrite only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partitions
    ).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write a folder anew."""
    df.write.mode("overwrite").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that may not be there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def store_batch(df: DataFrame, path: str, batch: int, ts: str = "ts") -> None:
    """Store a batch of events, one folder per day and batch; a repeated batch replaces its folders."""
    dated = df.withColumns({"event_date": F.to_date(ts), "batch": F.lit(batch).cast("long")})
    write_partitions(dated.filter(F.col("event_date").isNotNull()), path, ["event_date", "batch"])


def _days(spark: SparkSession, path: str) -> dict[str, list]:
    """The stored days and the paths of their batches, from folder names."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/event_date=*/batch=*")
    found: dict[str, list] = {}
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        found.setdefault(status.getPath().getParent().getName().split("=")[1], []).append(status.getPath())
    return found


def stored_events(spark: SparkSession, path: str, since: dt.datetime | None = None, ts: str = "ts") -> DataFrame:
    """Stored events, or those from ``since`` on: folders of earlier days are not read."""
    rows = spark.read.parquet(path)
    if since is None:
        return rows
    return rows.filter((F.col("event_date") >= F.lit(since.date())) & (F.col(ts) >= _at(rows, ts, since)))


def _at(rows: DataFrame, ts: str, time: dt.datetime) -> Column:
    """A time as a literal of the column's type, so that the comparison can be pushed down."""
    return F.lit(time).cast(rows.schema[ts].dataType)


def cutoff(spark: SparkSession, path: str, seconds: int, ts: str = "ts") -> dt.datetime | None:
    """The newest stored time less ``seconds``, from the newest day's folder."""
    days = _days(spark, path)
    if not days:
        return None
    newest = spark.read.parquet(path).filter(F.col("event_date") == F.lit(max(days)).cast("date")).agg(F.max(ts)).first()[0]
    return newest - dt.timedelta(seconds=seconds)


def drop_expired(spark: SparkSession, path: str, before: dt.datetime, ts: str = "ts") -> None:
    """Delete events older than ``before``.

    Days that are over go as folders, unread. Of the day the cutoff lies in, batches that
    still hold rows are rewritten, the others go, too.
    """
    day = before.date().isoformat()
    rows = spark.read.parquet(path).filter(F.col("event_date") == F.lit(day).cast("date"))
    bound, gone = _at(rows, ts, before), []
    for date, batches in _days(spark, path).items():
        if date < day:
            gone += batches
        elif date == day:
            spans = rows.groupBy("batch").agg((F.min(ts) < bound).alias("cut"), (F.max(ts) >= bound).alias("left")).collect()
            cut = [r.batch for r in spans if r.cut and r.left]
            if cut:
                write_partitions(rows.filter((F.col(ts) >= bound) & F.col("batch").isin(cut)), path, ["event_date", "batch"])
            over = {f"batch={r.batch}" for r in spans if not r.left}
            gone += [b for b in batches if b.getName() in over]
    for folder in gone:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
