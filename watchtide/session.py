"""Session helpers: settings the library relies on and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: event time is read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A cluster names that folder on storage every executor reaches. Only where it is unset
    and Spark runs in one process, as in tests, is a folder of this machine used; the
    session is left as it is.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{str(base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="watchtide-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result used more than once to the shared folder and read it back.

    Losing an executor then costs a read instead of the work before it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
