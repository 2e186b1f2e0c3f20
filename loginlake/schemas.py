"""Declared table layouts and the fixed values every job shares."""

from pyspark.sql import types as T

# Event kinds, in the order in which a line is tried against them.
KINDS = (
    "accepted",
    "session_opened",
    "session_closed",
    "invalid_user",
    "failed_password",
    "preauth_closed",
    "port_forward_error",
    "max_auth",
)

# Text a line must contain before its pattern is worth trying.
KIND_MARKER = {
    "accepted": "Accepted",
    "session_opened": "session opened for user",
    "session_closed": "session closed for user",
    "invalid_user": "Invalid user",
    "failed_password": "Failed password for",
    "preauth_closed": "Connection closed by",
    "port_forward_error": "connect_to",
    "max_auth": "maximum authentication attempts exceeded for",
}

# One pattern per kind; group 1 is always the process id.
KIND_PATTERN = {
    "accepted": r"sshd\[(\d+)\]:\s+Accepted\s+(\S+)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)",
    "session_opened": r"sshd\[(\d+)\]:\s+pam_unix\(sshd:session\):\s+session opened for user\s+(\S+?)(?:[\s(]|$)",
    "session_closed": r"sshd\[(\d+)\]:\s+pam_unix\(sshd:session\):\s+session closed for user\s+(\S+)",
    "invalid_user": r"sshd\[(\d+)\]:\s+Invalid user\s+(\S+)\s+from\s+(\S+)",
    "failed_password": r"sshd\[(\d+)\]:\s+Failed password for\s+(?:(invalid) user\s+)?(\S+)\s+from\s+(\S+)\s+port\s+(\d+)",
    "preauth_closed": r"sshd\[(\d+)\]:\s+Connection closed by\s+(\S+)\s+port\s+(\d+)\s+\[preauth\]",
    "port_forward_error": r"sshd\[(\d+)\]:\s+error:\s+connect_to\s+(\S+)\s+port\s+(\d+):\s+failed",
    "max_auth": r"sshd\[(\d+)\]:\s+maximum authentication attempts exceeded for\s+(?:(invalid) user\s+)?(\S+)\s+from\s+(\S+)",
}

# Which group of its pattern feeds which event column.
KIND_GROUPS = {
    "accepted": {"pid": 1, "auth_method": 2, "user": 3, "source_ip": 4, "port": 5},
    "session_opened": {"pid": 1, "user": 2},
    "session_closed": {"pid": 1, "user": 2},
    "invalid_user": {"pid": 1, "user": 2, "source_ip": 3},
    "failed_password": {"pid": 1, "invalid": 2, "user": 3, "source_ip": 4, "port": 5},
    "preauth_closed": {"pid": 1, "source_ip": 2, "port": 3},
    "port_forward_error": {"pid": 1, "fwd_host": 2, "fwd_port": 3},
    "max_auth": {"pid": 1, "invalid": 2, "user": 3, "source_ip": 4},
}

# Names and limits that show in results.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
OVERFLOW_LABEL = "__other__"
LABEL_CAPS = {"user": 200, "source_ip": 500, "auth_method": 32}
DURATION_BOUNDS = (60, 300, 900, 1800, 3600, 7200, 14400, 28800, 86400)
DEFAULT_LIMIT = 200
DEFAULT_HISTORY = 5000
TOP_SOURCES = 20
PENDING_LIMIT = 4096
HOSTNAME_TTL_SECONDS = 3600
NO_HOSTNAME_TTL_SECONDS = 300


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


_S, _L, _D, _NTZ = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

# Arrival order of a scanned line: older files first, then position inside the file.
FILE_SEQ = _struct(
    ("file_order", _L, True), ("file_id", _L, True),
    ("block_start", _L, True), ("row_id", _L, True),
)


def auth_events(seq=_L):
    return _struct(
        ("host", _S, False), ("pid", _S, False), ("kind", _S, False), ("user", _S, False),
        ("source_ip", _S, False), ("port", _S, False), ("auth_method", _S, False),
        ("invalid_user", T.BooleanType(), False), ("fwd_host", _S, False),
        ("fwd_port", _S, False), ("ts", _NTZ, True), ("seq", seq, False), ("line", _S, True),
    )


def sessions(seq=_L):
    return _struct(
        ("host", _S, False), ("pid", _S, False), ("user", _S, False), ("source_ip", _S, False),
        ("source_hostname", _S, False), ("source_display", _S, False),
        ("auth_method", _S, False), ("port", _S, False), ("login_time", _NTZ, True),
        ("logout_time", _NTZ, True), ("duration_seconds", _D, True),
        ("open_seq", seq, True), ("close_seq", seq, True),
    )


def failed_attempts(seq=_L):
    return _struct(
        ("timestamp", _NTZ, True), ("user", _S, False), ("source_ip", _S, False),
        ("source_hostname", _S, False), ("source_display", _S, False), ("port", _S, False),
        ("type", _S, False), ("invalid_user", T.BooleanType(), False), ("seq", seq, False),
    )


ACTIVE_SESSIONS = _struct(
    ("snapshot_id", _S, False), ("line_no", _L, False), ("user", _S, False), ("tty", _S, False),
    ("login_time", _S, False), ("source", _S, False), ("source_ip", _S, False),
    ("source_hostname", _S, False), ("source_display", _S, False),
)

PTR = _struct(("ip", _S, False), ("hostname", _S, False), ("resolved_at", _NTZ, False))

METRIC_SAMPLES = _struct(
    ("metric", _S, False), ("type", _S, False),
    ("labels", T.MapType(_S, _S), False), ("value", _D, False),
)
