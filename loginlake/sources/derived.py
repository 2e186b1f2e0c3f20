"""Log lines, login snapshots and reverse-DNS rows derived from an ``events`` table.

Used by the registered queries: their inputs hold no auth log, so every event is
written as the line or lines of text a server would have logged for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_NAMES = (
    "event_id", "user_id", "event_type", "ts",
    "CAST(user_id AS string) AS pid",
    "concat('user', user_id % 40) AS usr",
    "concat('ghost', event_id % 3) AS gst",
    "concat('10.0.', user_id % 7, '.', user_id % 5) AS ip",
    "CAST(1024 + event_id % 50000 AS string) AS port",
    "concat(date_format(ts, 'MMM '), lpad(dayofmonth(ts), 2, ' ')) AS month_day",
)

_GHOST_FAILED = "concat('Failed password for invalid user ', gst, origin, ' ssh2')"
_FIRST = f"""CASE event_type
  WHEN 'signup' THEN concat('Accepted ', if(event_id % 2 = 0, 'publickey', 'password'), ' for ', usr, origin, ' ssh2')
  WHEN 'purchase' THEN concat('pam_unix(sshd:session): session closed for user ', usr)
  WHEN 'error' THEN if(event_id % 4 = 0, {_GHOST_FAILED}, concat('Invalid user ', gst, origin))
  WHEN 'click' THEN if(event_id % 5 = 0,
    concat('maximum authentication attempts exceeded for ',
           if(event_id % 2 = 0, concat('invalid user ', gst), usr), origin, ' ssh2 [preauth]'),
    concat('Failed password for ', usr, origin, ' ssh2'))
  WHEN 'view' THEN CASE event_id % 4
    WHEN 0 THEN 'error: connect_to 10.9.9.9 port 80: failed.'
    WHEN 1 THEN 'pam_unix(cron:session): session opened for user root(uid=0) by (uid=0)'
    ELSE concat('Connection closed by ', ip, ' port ', port, ' [preauth]') END
END"""
_SECOND = f"""CASE
  WHEN event_type = 'signup' AND event_id % 7 <> 0
    THEN concat('pam_unix(sshd:session): session opened for user ', usr, '(uid=1000) by (uid=0)')
  WHEN event_type = 'error' AND event_id % 3 = 0 THEN {_GHOST_FAILED}
END"""


def log_lines(events: DataFrame) -> DataFrame:
    """(value, file_name, seq): one or two lines per event, one rotated file per day."""
    daemon = "if(event_type = 'view' AND event_id % 4 = 1, 'CRON[', 'sshd[')"
    rows = events.selectExpr(*_NAMES).selectExpr(
        "*",
        "concat(' from ', ip, ' port ', port) AS origin",
        f"concat(month_day, date_format(ts, ' HH:mm:ss'), ' host ', {daemon}, pid, ']: ') AS header",
    )
    rows = rows.selectExpr(
        "header",
        "if(dayofmonth(ts) = 31, 'auth.log', concat('auth.log.', 31 - dayofmonth(ts))) AS file_name",
        "2 * event_id AS base",
        f"posexplode(array({_FIRST}, {_SECOND})) AS (nth, message)",
    ).filter("message IS NOT NULL")
    return rows.selectExpr("concat(header, message) AS value", "file_name", "base + nth AS seq")


def who_lines(events: DataFrame) -> DataFrame:
    """(snapshot_id, line_no, value): one snapshot per day, one line per signup of that day."""
    return events.filter("event_type = 'signup'").selectExpr(*_NAMES).selectExpr(
        "date_format(ts, 'yyyy-MM-dd') AS snapshot_id",
        "event_id AS line_no",
        """concat(usr, ' pts/', event_id % 10, ' ',
          if(event_id % 2 = 0, date_format(ts, 'yyyy-MM-dd HH:mm'), concat(month_day, date_format(ts, ' HH:mm'))),
          CASE WHEN event_id % 11 = 0 THEN ''
            WHEN user_id % 4 = 0 THEN concat(' ', ip)
            WHEN user_id % 4 = 1 THEN concat(' (', ip, ')')
            WHEN user_id % 4 = 2 THEN ' :0'
            ELSE concat(' Client', user_id % 9, '.Example.COM.') END) AS value""",
    )


def ptr_rows(events: DataFrame) -> DataFrame:
    """(ip, hostname, resolved_at): one lookup per view; a third of them found no name."""
    return events.filter("event_type = 'view'").selectExpr(*_NAMES).selectExpr(
        "ip",
        """if(event_id % 3 = 0, '', concat('Host', user_id % 7, '-', user_id % 5, '.Example.com.')) AS hostname""",
        "ts AS resolved_at",
    )
