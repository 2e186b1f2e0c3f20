"""One pass over log lines that classifies each and takes its fields out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timestamps import add_syslog_timestamp, header_fields, header_host
from ..schemas import KIND_GROUPS, KIND_MARKER, KIND_PATTERN, KINDS

_FIELDS = ("pid", "user", "source_ip", "port", "auth_method", "invalid", "fwd_host", "fwd_port")


def event_kind(line: str) -> str:
    """SQL: kind of the first pattern found anywhere in the line, NULL for other lines."""
    # (?U): Unicode classes, so that spaces and digits mean what they mean in the log's text
    cases = [
        f"WHEN contains({line}, '{KIND_MARKER[k]}') AND {line} RLIKE r'(?U){KIND_PATTERN[k]}' THEN '{k}'"
        for k in KINDS
    ]
    return f"CASE {' '.join(cases)} END"


def _captured(line: str) -> str:
    """SQL: all captures of the pattern of ``kind``, as an array in the order of ``_FIELDS``.

    One match per line: the line is rewritten to its captures, separated by
    blanks, which no capture can contain.
    """
    cases = []
    for kind in KINDS:
        groups = KIND_GROUPS[kind]
        template = " ".join(f"${groups[f]}" if f in groups else "" for f in _FIELDS)
        whole = f"(?Us)^.*?(?:{KIND_PATTERN[kind]}).*$"
        cases.append(f"WHEN '{kind}' THEN regexp_replace({line}, r'{whole}', '{template}')")
    return f"split(CASE kind {' '.join(cases)} END, ' ')"


def is_recognised(line: str) -> Column:
    return F.expr(f"contains({line}, 'sshd[') AND {event_kind(line)} IS NOT NULL")


def parse_auth_events(
    lines: DataFrame, as_of, host_col: str | None = None, leap_day: bool = True
) -> DataFrame:
    """Events of the eight kinds found in ``lines`` (value, seq); other lines are dropped.

    ``as_of`` (date-time or column) settles the year missing in the headers.
    ``host_col`` names a column with the machine; without it the header tells.
    """
    rows = lines.filter(F.expr("contains(value, 'sshd[')"))
    # explode of one value: later filters on kind or date do not repeat the pattern search
    rows = rows.selectExpr("*", f"explode(array({event_kind('value')})) AS kind").filter("kind IS NOT NULL")
    rows = rows.selectExpr("*", f"explode(array({header_fields('value')})) AS _header")
    host = F.col(host_col) if host_col else header_host("value", "_header")
    rows = rows.withColumn("_fields", F.expr(_captured("value")))
    rows = add_syslog_timestamp(rows.withColumn("_host", host), "_header", as_of, leap_day)

    def text(name: str) -> str:
        return f"coalesce(get(_fields, {_FIELDS.index(name)}), '')"

    return rows.selectExpr(
        "coalesce(_host, '') AS host",
        f"{text('pid')} AS pid",
        "kind",
        f"{text('user')} AS user",
        f"{text('source_ip')} AS source_ip",
        f"{text('port')} AS port",
        f"{text('auth_method')} AS auth_method",
        f"{text('invalid')} <> '' AS invalid_user",
        f"{text('fwd_host')} AS fwd_host",
        f"{text('fwd_port')} AS fwd_port",
        "ts",
        "seq",
        "value AS line",
    )


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind with the columns that kind fills."""
    filled = {
        "accepted": ("user", "source_ip", "port", "auth_method"),
        "session_opened": ("user",),
        "session_closed": ("user",),
        "invalid_user": ("user", "source_ip"),
        "failed_password": ("user", "source_ip", "port", "invalid_user"),
        "preauth_closed": ("source_ip", "port"),
        "port_forward_error": ("fwd_host", "fwd_port"),
        "max_auth": ("user", "source_ip", "invalid_user"),
    }[kind]
    return events.filter(F.col("kind") == kind).select("seq", "host", "pid", *filled, "ts")
