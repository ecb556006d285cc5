"""Reading raw tables, log files and documents into the event schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_FILE_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

# Names used when a mapped field is missing or empty.
DEFAULT_EVENT_TYPE = "external_event"
DEFAULT_SOURCE = "connector"
# Numbers below this are epoch seconds, others epoch milliseconds.
MILLIS_FROM = 1e12


def micros(ts: str | Column) -> Column:
    """Event time as whole microseconds, the unit every time window here uses."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts)


def epoch_of_number(value: Column, now: Column) -> Column:
    value = value.cast("double")
    return F.coalesce(F.when(value < MILLIS_FROM, value).otherwise(value / 1000), now)


def epoch_of_text(value: Column, now: Column) -> Column:
    parsed = F.unix_micros(F.try_to_timestamp(value)) / 1_000_000
    return F.coalesce(parsed, now)


def normalize_epoch(df: DataFrame, column: str, now: Column) -> Column:
    """Epoch seconds of a number or text column; ``now`` where there is nothing to read."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return epoch_of_text(F.col(column), now)
    if isinstance(kind, T.NumericType):
        return epoch_of_number(F.col(column), now)
    return F.coalesce(micros(column) / 1_000_000, now)


def signals(df: DataFrame, mapping: Mapping[str, str], now: Column) -> DataFrame:
    """Project raw rows to (id, event_type, source, epoch, ts) by a field mapping."""

    def text(field: str, default: str | None) -> Column:
        if field not in mapping:
            return F.lit(default)
        value = F.nullif(F.col(mapping[field]).cast("string"), F.lit(""))
        return value if default is None else F.coalesce(value, F.lit(default))

    epoch = normalize_epoch(df, mapping["timestamp"], now) if "timestamp" in mapping else now
    return df.select(
        text("id", None).alias("id"),
        text("event_type", DEFAULT_EVENT_TYPE).alias("event_type"),
        text("source", DEFAULT_SOURCE).alias("source"),
        epoch.alias("epoch"),
    ).withColumn("ts", F.timestamp_micros((F.col("epoch") * 1_000_000).cast("long")))


def incremental_read(df: DataFrame, id_col: str, mark: int, limit: int | None = None) -> DataFrame:
    """The next poll: rows after the high-water mark in id order, all or the first ``limit``."""
    rows = df.filter(F.col(id_col) > mark).orderBy(id_col)
    return rows if limit is None else rows.limit(limit)


def high_water_mark(batch: DataFrame, id_col: str, mark: int) -> DataFrame:
    """The mark to use for the next poll, unchanged when the batch is empty."""
    return batch.agg(F.greatest(F.coalesce(F.max(id_col), F.lit(mark)), F.lit(mark)).alias("mark"))


def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """Sample files holding one JSON array of events."""
    return spark.read.schema(EVENT_FILE_SCHEMA).option("multiLine", True).json(path)


def replay_rebase(df: DataFrame, t: str, seq: str, start: float) -> DataFrame:
    """Shift all times so that the first row by ``seq`` happens at ``start``."""
    first = df.agg(F.min_by(t, seq)).scalar()
    return df.withColumn(t, F.col(t) - first + F.lit(start))


def union_log_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Stack log tables of one schema, each row tagged with its table."""
    tagged = [df.withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def discover_schema(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column with the table's row count."""

    def one(name: str, df: DataFrame) -> DataFrame:
        fields = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("column_type"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        return counted.select(
            F.lit(name).alias("table_name"), "row_count", F.inline(fields)
        )

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a parallel JDBC scan; the three partitioning values go together."""
    split = (partition_column, bounds, partitions)
    if any(v is not None for v in split) and any(v is None for v in split):
        raise ValueError("partition_column, bounds and partitions must be given together")
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if partition_column is not None:
        opts["partitionColumn"] = partition_column
        opts["lowerBound"], opts["upperBound"] = (str(b) for b in bounds)
        opts["numPartitions"] = str(partitions)
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def read_documents(
    spark: SparkSession, path: str, extensions: Iterable[str] = ("md", "txt", "json")
) -> DataFrame:
    """Text files below a folder, one row per file, blank files dropped."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .text(path, wholetext=True)
    )
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = raw.select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_name").alias("filename"),
        folder.alias("directory"),
    )
    return drop_blank(rows, "text")


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).rlike(r"\S"))


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work all cores when the input comes in fewer splits than cores.

    An input with enough splits, as any large one has, is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
