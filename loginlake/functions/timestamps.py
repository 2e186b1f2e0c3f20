"""Syslog header dates, report range arguments and range filters."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MONTHS

_MONTHS = "".join(MONTHS)
# Fixed formats: "Mar  8 00:17:01 host " and "2026-03-08T00:17:01+01:00 host " in front of a message.
_HEADER = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+)\s"
_ISO_HEADER = r"^\d{4}-\d{2}-\d{2}T\S+\s+(\S+)\s"


def header_fields(line: str) -> str:
    """SQL: [month, day, time, host] of a syslog header, or [''] without one."""
    return rf"split(regexp_extract({line}, r'{_HEADER}', 1), r'\s+', 4)"


def header_host(line: str, header: str) -> Column:
    """Host named in the header; lines with an ISO date in front have it second."""
    return F.expr(f"coalesce(get({header}, 3), regexp_extract({line}, r'{_ISO_HEADER}', 1))")


def as_of_column(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is not None:
        raise ValueError("as_of must be a naive date-time")
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def add_syslog_timestamp(rows: DataFrame, header: str, as_of, leap_day: bool = True) -> DataFrame:
    """Adds ``ts``; the year, which headers lack, is the latest that is not in the future.

    ``as_of`` plays the part of the clock; it may be a column (for instance the
    modification time of the file) when one table spans several years.  With
    ``leap_day=False`` the 29th of February gives NULL.
    """
    place = f"instr('{_MONTHS}', lower(get({header}, 0)))"
    month = f"CASE WHEN {place} % 3 = 1 THEN ({place} + 2) DIV 3 END"
    rows = rows.withColumns(
        {
            "_now": as_of_column(as_of),
            "_day": F.expr(f"concat('-', {month}, '-', get({header}, 1), ' ', get({header}, 2))"),
        }
    )
    # the cast checks day, hour, minute and second; what does not exist becomes NULL
    rows = rows.withColumns(
        {
            "_this": F.expr("try_cast(concat(year(_now), _day) AS timestamp_ntz)"),
            "_last": F.expr("try_cast(concat(year(_now) - 1, _day) AS timestamp_ntz)"),
        }
    )
    if leap_day:
        # a leap day that this year lacks can only be last year's
        late = "_this > _now + INTERVAL 1 DAY OR (_this IS NULL AND startswith(_day, '-2-29 '))"
        ts = f"CASE WHEN {late} THEN _last ELSE _this END"
    else:
        ts = "CASE WHEN startswith(_day, '-2-29 ') THEN NULL WHEN _this > _now + INTERVAL 1 DAY THEN _last ELSE _this END"
    return rows.withColumn("ts", F.expr(ts)).drop("_now", "_day", "_this", "_last")


def parse_time_argument(value, session_zone: str = "UTC") -> datetime | None:
    """ISO-8601 text (``Z`` and offsets allowed) as a naive date-time of the session zone."""
    moment = datetime.fromisoformat(value.strip()) if isinstance(value, str) else value
    if moment is None or moment.utcoffset() is None:
        return moment
    return moment.astimezone(ZoneInfo(session_zone)).replace(tzinfo=None)


def within(df: DataFrame, moment: Column, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; without bounds every row stays.

    Saved tables are partitioned by the day of the moment (``event_date``); the days are
    bounded too, so that only theirs are read.
    """
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    for bound, keep in ((start, Column.__ge__), (end, Column.__le__)):
        bound = parse_time_argument(bound, zone)
        if bound is not None:
            df = df.filter(keep(moment, as_of_column(bound)))
            if "event_date" in df.columns:
                df = df.filter(keep(F.col("event_date"), F.lit(bound.date())))
    return df


def iso_text(moment: Column) -> Column:
    """Date-time as ISO text for JSON output; NULL stays NULL."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
