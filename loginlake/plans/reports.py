"""The questions users ask: history, failures, summary, tops, heatmap, user status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arguments import report_limit
from ..functions.sources import or_else
from ..functions.timestamps import iso_text, within
from ..operators.enrich import enrich_hosts
from ..operators.metrics import day_name, latest_snapshot, logins_by_hour
from ..schemas import TOP_SOURCES


def retained(rows: DataFrame, order: str, max_history: int | None) -> DataFrame:
    """The last ``max_history`` rows by arrival; all of them if it is None."""
    return rows if max_history is None else rows.orderBy(F.col(order).desc()).limit(max_history)


def session_history(sessions: DataFrame, limit=None, start=None, end=None, max_history: int | None = None) -> DataFrame:
    """Latest finished sessions of a time range, newest arrival first."""
    rows = within(retained(sessions, "close_seq", max_history), F.col("logout_time"), start, end)
    return rows.orderBy(F.col("close_seq").desc()).limit(report_limit(limit, max_history))


def failed_history(failed: DataFrame, limit=None, start=None, end=None, max_history: int | None = None) -> DataFrame:
    """Latest failed attempts of a time range, newest arrival first."""
    rows = within(retained(failed, "seq", max_history), F.col("timestamp"), start, end)
    return rows.orderBy(F.col("seq").desc()).limit(report_limit(limit, max_history))


def summary(sessions: DataFrame, failed: DataFrame, users: DataFrame, max_history: int | None = None) -> DataFrame:
    """One row of totals; negative durations take part in the average."""
    count = F.count(F.lit(1))
    sessions, failed = retained(sessions, "close_seq", max_history), retained(failed, "seq", max_history)
    average = F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 1)
    totals = sessions.agg(count.alias("total_sessions"), average.alias("average_session_duration_seconds"))
    return totals.select(
        "total_sessions",
        failed.agg(count.alias("n")).scalar().alias("total_failed_attempts"),
        users.agg(F.count_distinct("user").alias("n")).scalar().alias("unique_user_count"),
        "average_session_duration_seconds",
    )


def logins_per_user(sessions: DataFrame, max_history: int | None = None) -> DataFrame:
    """Finished sessions per user."""
    return retained(sessions, "close_seq", max_history).groupBy("user").agg(F.count(F.lit(1)).alias("logins"))


def top_values(sessions: DataFrame, column: str, n: int = TOP_SOURCES, max_history: int | None = None) -> DataFrame:
    """Most frequent non-empty values; equal counts stay in order of first appearance."""
    rows = retained(sessions, "close_seq", max_history).filter(F.col(column) != "")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("sessions"), F.min("close_seq").alias("_first"))
    return counts.orderBy(F.col("sessions").desc(), "_first").limit(n).drop("_first")


def unique_user_names(users: DataFrame) -> DataFrame:
    return users.select("user").distinct().orderBy("user")


def heatmap(events: DataFrame, start=None, end=None, max_history: int | None = None) -> DataFrame:
    """Seven rows Mon..Sun with 24 hour columns of accepted logins.

    A time range looks at the retained logins only, the full table at all of them.
    """
    if start is not None or end is not None:
        dated = events.filter((F.col("kind") == "accepted") & F.col("ts").isNotNull())
        events = within(retained(dated, "seq", max_history), F.col("ts"), start, end)
    hours = [f"{h:02d}" for h in range(24)]
    cells = logins_by_hour(events).withColumn("hour", F.lpad(F.col("hour").cast("string"), 2, "0"))
    counts = F.broadcast(cells.groupBy("weekday").pivot("hour", hours).agg(F.sum("n")))  # 7 rows at most
    days = events.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return (
        days.join(counts, "weekday", "left")
        .orderBy("weekday")
        .select(
            day_name(F.col("weekday")).alias("day"),
            *[F.coalesce(F.col(h), F.lit(0)).alias(h) for h in hours],
        )
    )


def current_sessions(active: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Remote sessions of the newest snapshot."""
    return active.filter(F.col("snapshot_id") == latest_snapshot(snapshots))


def users_status(users: DataFrame, active: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Known and active users with status, session count and sorted sources."""
    shown = F.nullif(or_else(F.col("source_display"), F.col("source")), F.lit(""))
    here = current_sessions(active, snapshots).groupBy("user", shown.alias("display")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = users.select("user", F.lit(None).cast("string").alias("display"), F.lit(0).cast("bigint").alias("n"))
    per_user = known.unionByName(here).groupBy("user").agg(
        F.sum("n").alias("sessions"), F.array_sort(F.collect_set("display")).alias("displays")
    )
    return per_user.orderBy("user").select(
        "user",
        F.when(F.col("sessions") > 0, "Online").otherwise("Offline").alias("status"),
        "sessions",
        F.array_join("displays", ", ").alias("sources"),
    )


SESSION_FIELDS = (
    "pid", "user", "source_ip", "source_hostname", "source_display", "auth_method", "port", "login_time", "logout_time",
    "duration_seconds",
)
FAILED_FIELDS = ("timestamp", "user", "source_ip", "source_hostname", "source_display", "port", "type")


def session_json(sessions: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(value, close_seq): sessions as JSON texts with all their fields, or some such as SESSION_FIELDS."""
    return json_rows(sessions, "close_seq", fields)


def failed_json(failed: DataFrame) -> DataFrame:
    """(value, seq): failed attempts as JSON texts with the fields a report shows."""
    return json_rows(failed, "seq", FAILED_FIELDS)


def top_sources(sessions: DataFrame, ptr: DataFrame, n: int = TOP_SOURCES, max_history: int | None = None) -> DataFrame:
    """Most frequent source names: sessions are counted by address, names joined to the counts."""
    rows = retained(sessions, "close_seq", max_history)
    address = [c for c in ("source_ip", "source_hostname", "source_display") if c in rows.columns]
    counts = rows.groupBy(*address).agg(F.count(F.lit(1)).alias("n"), F.min("close_seq").alias("first"))
    shown = enrich_hosts(counts, ptr).filter(F.col("source_display") != "")
    names = shown.groupBy("source_display").agg(F.sum("n").alias("sessions"), F.min("first").alias("_first"))
    return names.orderBy(F.col("sessions").desc(), "_first").limit(n).drop("_first")


def json_rows(report: DataFrame, order: str | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One JSON text per row, next to the column ``order``: all columns or ``fields``, dates in ISO form, missing values kept as null."""
    columns = [
        iso_text(F.col(c)).alias(c) if report.schema[c].dataType.typeName().startswith("timestamp") else F.col(c)
        for c in fields or report.columns
    ]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return report.select(text.alias("value"), *([order] if order else []))
