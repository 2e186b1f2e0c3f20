"""The persisted tables that reports and metrics read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.failures import failed_attempts
from ..operators.sessions import sessions


def _write(df: DataFrame, path: str, ts: str, mode: str) -> None:
    """Writes by date, in few files a day; overwriting replaces the days that come, no others."""
    dated = df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date")
    writer = dated.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date").parquet(path)


def save_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Events by date, so that range reports read only their days and only once-parsed rows."""
    _write(events, path, "ts", mode)


def save_correlated(spark: SparkSession, events_path: str, sessions_path: str, failed_path: str, as_of) -> None:
    """Session and failure tables from the saved events, which are parsed only once."""
    events = spark.read.parquet(events_path)
    _write(sessions(events, as_of), sessions_path, "logout_time", "overwrite")
    _write(failed_attempts(events), failed_path, "timestamp", "overwrite")


def save_json(report: DataFrame, path: str) -> None:
    from .reports import json_rows

    json_rows(report).write.mode("overwrite").text(path)


def append_samples(samples: DataFrame, path: str) -> None:
    """Adds metric samples to a table, partitioned by metric."""
    samples.write.mode("append").partitionBy("metric").parquet(path)
