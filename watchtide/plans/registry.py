"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables as DataFrames; only the columns a query uses are scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sig(self) -> DataFrame:
        """Security signals played by the ``events`` table (see SIG for the same in SQL)."""
        return self._signals(F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))

    def _signals(self, ts: Column) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for pair in SIGNAL_TYPES.items() for x in pair])
        return self.events.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % 4).alias("org"),
            kind[F.col("event_type")].alias("event_type"),
            F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"),
            F.concat(F.lit("u"), F.col("user_id")).alias("user_name"),
            F.floor(F.col("value") * 100).cast("long").alias("bytes"),
            F.col("value"),
            ts.alias("ts"),
        )

    def dated(self) -> DataFrame:
        """Signals whose ``ts`` is the stored column, for filters that the scan can use."""
        return self._signals(F.col("ts"))

    def cases(self) -> DataFrame:
        """Incidents and cases played by the ``orders`` table (CASES in SQL)."""
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("o_custkey") % 4).alias("org"),
            F.when(F.col("o_orderstatus") == "F", "closed")
            .when(F.col("o_orderstatus") == "O", "open")
            .otherwise("investigating")
            .alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL")
            .when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM")
            .otherwise("LOW")
            .alias("severity"),
            F.col("o_totalprice").alias("score"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            (F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("created_sec"),
        )


SIGNAL_TYPES = {
    "error": "login_failed",
    "signup": "login_success",
    "purchase": "data_export",
    "click": "admin_add",
    "view": "page_view",
}

SIG = """sig AS (
  SELECT event_id AS id, user_id % 4 AS org,
         CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_success'
              WHEN 'purchase' THEN 'data_export' WHEN 'click' THEN 'admin_add'
              ELSE 'page_view' END AS event_type,
         'src' || (user_id % 20) AS source, 'u' || user_id AS user_name,
         CAST(floor(value * 100) AS BIGINT) AS bytes, value, ts, epoch_us(ts) AS us
  FROM events)"""

CASES = """cases AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, o_custkey % 4 AS org,
         CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open'
              ELSE 'investigating' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
              WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         o_totalprice AS score, o_orderdate AS created_at,
         CAST(epoch(o_orderdate) AS BIGINT) AS created_sec
  FROM orders)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its SQL twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
