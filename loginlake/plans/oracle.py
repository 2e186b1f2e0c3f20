"""The registered queries as SQL over the same tables.

Answers are computed from the columns of ``events``, not from log text, and by
other means than the library's: as-of joins for sessions, a recursive walk for
merged reports.  The text of lines is built by other means as well.
"""

from __future__ import annotations

from ..schemas import DURATION_BOUNDS

_EVENTS = """
e AS (
  SELECT event_id, user_id, event_type, ts AS full_ts, date_trunc('second', ts) AS ts,
         CAST(user_id AS VARCHAR) AS pid, 'user' || (user_id % 40) AS usr,
         'ghost' || (event_id % 3) AS gst, '10.0.' || (user_id % 7) || '.' || (user_id % 5) AS ip,
         CAST(1024 + event_id % 50000 AS VARCHAR) AS port
  FROM events
),
a AS (
  SELECT 2 * event_id AS seq, pid, 'accepted' AS kind, usr AS u, ip, port,
         CASE WHEN event_id % 2 = 0 THEN 'publickey' ELSE 'password' END AS method,
         false AS inv, '' AS fh, '' AS fp, ts FROM e WHERE event_type = 'signup'
  UNION ALL SELECT 2 * event_id + 1, pid, 'session_opened', usr, '', '', '', false, '', '', ts
    FROM e WHERE event_type = 'signup' AND event_id % 7 <> 0
  UNION ALL SELECT 2 * event_id, pid, 'session_closed', usr, '', '', '', false, '', '', ts
    FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT 2 * event_id, pid, 'failed_password', gst, ip, port, '', true, '', '', ts
    FROM e WHERE event_type = 'error' AND event_id % 4 = 0
  UNION ALL SELECT 2 * event_id, pid, 'invalid_user', gst, ip, '', '', false, '', '', ts
    FROM e WHERE event_type = 'error' AND event_id % 4 <> 0
  UNION ALL SELECT 2 * event_id + 1, pid, 'failed_password', gst, ip, port, '', true, '', '', ts
    FROM e WHERE event_type = 'error' AND event_id % 3 = 0
  UNION ALL SELECT 2 * event_id, pid, 'max_auth', CASE WHEN event_id % 2 = 0 THEN gst ELSE usr END,
         ip, '', '', event_id % 2 = 0, '', '', ts
    FROM e WHERE event_type = 'click' AND event_id % 5 = 0
  UNION ALL SELECT 2 * event_id, pid, 'failed_password', usr, ip, port, '', false, '', '', ts
    FROM e WHERE event_type = 'click' AND event_id % 5 <> 0
  UNION ALL SELECT 2 * event_id, pid, 'port_forward_error', '', '', '', '', false, '10.9.9.9', '80', ts
    FROM e WHERE event_type = 'view' AND event_id % 4 = 0
  UNION ALL SELECT 2 * event_id, pid, 'preauth_closed', '', ip, port, '', false, '', '', ts
    FROM e WHERE event_type = 'view' AND event_id % 4 > 1
)"""

_SESSIONS = """
o AS (
  SELECT x.seq, x.pid, x.u, x.ts, 
         CASE WHEN p.kind = 'accepted' THEN p.ip ELSE '' END AS ip,
         CASE WHEN p.kind = 'accepted' THEN p.method ELSE '' END AS method,
         CASE WHEN p.kind = 'accepted' THEN p.port ELSE '' END AS port
  FROM (SELECT * FROM a WHERE kind = 'session_opened') x
  ASOF LEFT JOIN (SELECT * FROM a WHERE kind IN ('accepted', 'session_opened')) p
    ON x.pid = p.pid AND x.seq > p.seq
),
s AS (
  SELECT 'host' AS host, o.pid AS pid, o.u AS u, o.ip AS ip, o.method AS method, o.port AS port,
         o.ts AS login_time, c.ts AS logout_time,
         CAST(date_diff('second', o.ts, c.ts) AS DOUBLE) AS secs,
         o.seq AS open_seq, c.seq AS close_seq, c.u AS close_u
  FROM (SELECT * FROM a WHERE kind = 'session_closed') c
  ASOF JOIN (SELECT seq, pid, kind FROM a WHERE kind IN ('session_opened', 'session_closed')) p
    ON c.pid = p.pid AND c.seq > p.seq
  JOIN o ON o.seq = p.seq
  WHERE p.kind = 'session_opened'
)"""

_FAILED = """
d AS (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq) AS rn
  FROM a WHERE kind = 'invalid_user' OR (kind = 'failed_password' AND inv)
),
walk AS (
  SELECT pid, rn, true AS counted, u AS pu, ip AS pi FROM d WHERE rn = 1
  UNION ALL
  SELECT d.pid, d.rn, NOT coalesce(w.pu = d.u AND w.pi = d.ip, false),
         CASE WHEN coalesce(w.pu = d.u AND w.pi = d.ip, false) THEN NULL ELSE d.u END,
         CASE WHEN coalesce(w.pu = d.u AND w.pi = d.ip, false) THEN NULL ELSE d.ip END
  FROM walk w JOIN d ON d.pid = w.pid AND d.rn = w.rn + 1
),
counted AS (
  SELECT d.*, CASE WHEN d.port = '' AND n.kind = 'failed_password' AND NOT nw.counted
                   THEN n.port ELSE d.port END AS full_port
  FROM d JOIN walk w ON w.pid = d.pid AND w.rn = d.rn AND w.counted
  LEFT JOIN d n ON n.pid = d.pid AND n.rn = d.rn + 1
  LEFT JOIN walk nw ON nw.pid = d.pid AND nw.rn = d.rn + 1
),
f AS (
  SELECT seq, ts, u, ip, full_port AS port, 'invalid_user' AS type, true AS inv FROM counted
  UNION ALL SELECT seq, ts, u, ip, port, 'failed_password', false FROM a
    WHERE kind = 'failed_password' AND NOT inv
  UNION ALL SELECT seq, ts, u, ip, '', 'max_auth_exceeded', inv FROM a WHERE kind = 'max_auth'
)"""

_FULL_REGISTRY = """
sight AS (
  SELECT 'user' AS dimension, u AS value, 2 * seq + 1 AS pos FROM a
    WHERE kind IN ('accepted', 'session_closed', 'max_auth')
  UNION ALL SELECT 'user', u, 2 * seq + 1 FROM f
  UNION ALL SELECT 'user', u, 2 * close_seq FROM s WHERE secs >= 0
  UNION ALL SELECT 'source_ip', ip, 2 * seq + 1 FROM a
    WHERE kind IN ('accepted', 'max_auth', 'preauth_closed')
  UNION ALL SELECT 'source_ip', ip, 2 * seq + 1 FROM f
  UNION ALL SELECT 'auth_method', method, 2 * seq + 1 FROM a WHERE kind = 'accepted'
),
ranked AS (
  SELECT dimension, value, CASE WHEN dimension = 'source_ip' THEN value ELSE '' END AS display, position
  FROM (
    SELECT dimension, value, CAST(row_number() OVER (PARTITION BY dimension ORDER BY min(pos)) AS INT) AS position
    FROM sight GROUP BY dimension, value
  )
)"""

_LABELS = _FULL_REGISTRY + """,
reg AS (
  SELECT * FROM ranked
  WHERE position <= CASE dimension WHEN 'user' THEN 12 WHEN 'source_ip' THEN 10 ELSE 1 END
)"""

_WHO = """
w AS (
  SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, event_id AS line_no, usr AS u,
         'pts/' || (event_id % 10) AS tty,
         CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M')
              ELSE strftime(ts, '%b ') || day(ts) || strftime(ts, ' %H:%M') END AS login_time,
         CASE WHEN event_id % 11 = 0 THEN '' WHEN user_id % 4 < 2 THEN ip WHEN user_id % 4 = 2 THEN ':0'
              ELSE 'Client' || (user_id % 9) || '.Example.COM.' END AS source
  FROM e WHERE event_type = 'signup'
),
wd AS (
  SELECT *, CASE WHEN source LIKE 'Client%' THEN lower(rtrim(source, '.'))
                 WHEN source LIKE ':%' THEN source ELSE '' END AS hostname,
         CASE WHEN source LIKE 'Client%' THEN lower(rtrim(source, '.')) ELSE source END AS display
  FROM w
),
act AS (SELECT * FROM wd WHERE source NOT IN ('', ':0')),
now AS (SELECT * FROM act WHERE snapshot_id = (SELECT max(snapshot_id) FROM w))"""

_PTR = """
ptr AS (
  SELECT ip, full_ts AS looked_up, CASE WHEN event_id % 3 = 0 THEN ''
         ELSE 'host' || (user_id % 7) || '-' || (user_id % 5) || '.example.com' END AS name
  FROM e WHERE event_type = 'view'
),
newest AS (
  SELECT ip, name FROM ptr p WHERE looked_up = (SELECT max(looked_up) FROM ptr q WHERE q.ip = p.ip)
)"""

_TEXT = """
t AS (
  SELECT 2 * event_id AS seq, 'sshd[' || pid || ']: Accepted ' || CASE WHEN event_id % 2 = 0 THEN 'publickey'
         ELSE 'password' END || ' for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2' AS msg, ts
    FROM e WHERE event_type = 'signup'
  UNION ALL SELECT 2 * event_id + 1, 'sshd[' || pid || ']: pam_unix(sshd:session): session opened for user '
         || usr || '(uid=1000) by (uid=0)', ts FROM e WHERE event_type = 'signup' AND event_id % 7 <> 0
  UNION ALL SELECT 2 * event_id, 'sshd[' || pid || ']: pam_unix(sshd:session): session closed for user ' || usr, ts
    FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT 2 * event_id, 'sshd[' || pid || ']: ' || CASE WHEN event_id % 4 = 0
         THEN 'Failed password for invalid user ' || gst || ' from ' || ip || ' port ' || port || ' ssh2'
         ELSE 'Invalid user ' || gst || ' from ' || ip || ' port ' || port END, ts
    FROM e WHERE event_type = 'error'
  UNION ALL SELECT 2 * event_id + 1, 'sshd[' || pid || ']: Failed password for invalid user ' || gst || ' from '
         || ip || ' port ' || port || ' ssh2', ts FROM e WHERE event_type = 'error' AND event_id % 3 = 0
  UNION ALL SELECT 2 * event_id, 'sshd[' || pid || ']: maximum authentication attempts exceeded for '
         || CASE WHEN event_id % 2 = 0 THEN 'invalid user ' || gst ELSE usr END || ' from ' || ip || ' port '
         || port || ' ssh2 [preauth]', ts FROM e WHERE event_type = 'click' AND event_id % 5 = 0
  UNION ALL SELECT 2 * event_id, 'sshd[' || pid || ']: Failed password for ' || usr || ' from ' || ip || ' port '
         || port || ' ssh2', ts FROM e WHERE event_type = 'click' AND event_id % 5 <> 0
  UNION ALL SELECT 2 * event_id, 'sshd[' || pid || ']: error: connect_to 10.9.9.9 port 80: failed.', ts
    FROM e WHERE event_type = 'view' AND event_id % 4 = 0
  UNION ALL SELECT 2 * event_id, 'CRON[' || pid
         || ']: pam_unix(cron:session): session opened for user root(uid=0) by (uid=0)', ts
    FROM e WHERE event_type = 'view' AND event_id % 4 = 1
  UNION ALL SELECT 2 * event_id, 'sshd[' || pid || ']: Connection closed by ' || ip || ' port ' || port
         || ' [preauth]', ts FROM e WHERE event_type = 'view' AND event_id % 4 > 1
),
lines AS (
  SELECT seq, strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S')
         || ' host ' || msg AS line, day(ts) AS dom FROM t
)"""

def _with(body: str, *tables: str) -> str:
    return "WITH RECURSIVE " + ",".join(tables) + "\n" + body


def _cells(rows: str, ts: str = "ts") -> str:
    hours = ", ".join(
        f"CAST(count(*) FILTER (WHERE hour({ts}) = {h} AND isodow({ts}) = d) AS BIGINT) AS \"{h:02d}\"" for h in range(24)
    )
    return (
        f"SELECT day, {hours} FROM (VALUES ('Mon',1),('Tue',2),('Wed',3),('Thu',4),('Fri',5),('Sat',6),('Sun',7))"
        f" v(day, d), ({rows}) r GROUP BY day"
    )


_SESSION_COLS = """host, pid, u AS "user", ip AS source_ip, '' AS source_hostname, ip AS source_display,
  method AS auth_method, port, login_time, logout_time, secs AS duration_seconds, open_seq, close_seq"""
_FAILED_COLS = """ts AS timestamp, u AS "user", ip AS source_ip, '' AS source_hostname, ip AS source_display,
  port, type, inv AS invalid_user, seq"""
_RANGE = "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"
_WHO_COLS = """snapshot_id, line_no, u AS "user", tty, login_time, display AS source, source AS source_ip,
  hostname AS source_hostname, display AS source_display"""


def _ev(kind: str, columns: str) -> str:
    return _with(f"SELECT seq, 'host' AS host, pid, {columns}, ts FROM a WHERE kind = '{kind}'", _EVENTS)


def _labelled(source: str, user: bool = True) -> str:
    return f"""SELECT coalesce(ru.value, '__other__') AS "user", coalesce(ri.value, '__other__') AS source_ip,
      coalesce(ri.display, '__other__') AS source_display, count(*) AS value
      FROM {source} x LEFT JOIN reg ru ON ru.dimension = 'user' AND ru.value = x.u
      LEFT JOIN reg ri ON ri.dimension = 'source_ip' AND ri.value = x.ip GROUP BY ALL"""


_HIST = " UNION ALL ".join(
    [
        f"SELECT u AS \"user\", 'bucket' AS series, '{b}' AS le, CAST(count(*) FILTER (WHERE secs <= {b}) AS DOUBLE)"
        " AS value FROM s WHERE secs >= 0 GROUP BY u"
        for b in DURATION_BOUNDS
    ]
    + [
        "SELECT u, 'bucket', '+Inf', CAST(count(*) AS DOUBLE) FROM s WHERE secs >= 0 GROUP BY u",
        "SELECT u, 'sum', '', CAST(sum(secs) AS DOUBLE) FROM s WHERE secs >= 0 GROUP BY u",
        "SELECT u, 'count', '', CAST(count(*) AS DOUBLE) FROM s WHERE secs >= 0 GROUP BY u",
    ]
)
_US = """SELECT DISTINCT u FROM a WHERE kind IN ('accepted', 'session_opened')"""
_GAUGE = """SELECT u AS "user", source AS source_ip, display AS source_display,
  count(*) FILTER (WHERE snapshot_id = (SELECT max(snapshot_id) FROM w)) AS value FROM act GROUP BY ALL"""
_ONLINE = f"""SELECT u AS "user", CAST(CASE WHEN u IN (SELECT u FROM now) THEN 1 ELSE 0 END AS BIGINT) AS value
  FROM ({_US} UNION SELECT u FROM act)"""
_HEAT = """SELECT day_of_week, lpad(CAST(h AS VARCHAR), 2, '0') AS hour, count(x.seq) AS value
  FROM (VALUES ('Mon',1),('Tue',2),('Wed',3),('Thu',4),('Fri',5),('Sat',6),('Sun',7)) v(day_of_week, d)
  CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT * FROM a WHERE kind = 'accepted') x
  ON isodow(x.ts) = d AND hour(x.ts) = h GROUP BY ALL"""
_ERRORS = """SELECT CASE kind WHEN 'max_auth' THEN 'max_auth_exceeded' ELSE 'port_forward_failed' END AS error_type,
  count(*) AS value FROM a WHERE kind IN ('max_auth', 'port_forward_error') GROUP BY ALL"""
_TTL = """SELECT x.*, coalesce(CASE WHEN p.looked_up + to_seconds(CASE WHEN p.name = '' THEN 300 ELSE 3600 END) > x.ts
       THEN p.name END, '') AS name FROM ({rows}) x ASOF LEFT JOIN ptr p ON x.ip = p.ip AND x.ts >= p.looked_up"""


def _display(name: str, ip: str) -> str:
    return f"CASE WHEN coalesce({name}, '') = '' THEN {ip} ELSE {name} || ' (' || {ip} || ')' END"


def _samples_sql(snapshots: bool = True) -> str:
    def label(*names):
        return " || ',' || ".join(f"'{n}=' || \"{n}\"" for n in sorted(names)) if names else "''"

    def rows(metric, kind, sql, *names):
        return f"SELECT '{metric}' AS metric, '{kind}' AS type, {label(*names)} AS labels, CAST(value AS DOUBLE) AS value FROM ({sql})"

    us = ("user", "source_ip", "source_display")
    ip_cols = "ip AS source_ip, ip AS source_display"
    hist = (
        "SELECT 'ssh_session_duration_seconds_' || series AS metric, 'histogram' AS type,"
        " CASE WHEN series = 'bucket' THEN 'le=' || le || ',' ELSE '' END || 'user=' || \"user\" AS labels, value"
        f" FROM ({_HIST})"
    )
    parts = [
        rows("ssh_logins_total", "counter", f'SELECT u AS "user", {ip_cols}, method AS auth_method, count(*) AS value'
             " FROM a WHERE kind = 'accepted' GROUP BY ALL", *us, "auth_method"),
        rows("ssh_logouts_total", "counter", 'SELECT u AS "user", count(*) AS value FROM a'
             " WHERE kind = 'session_closed' GROUP BY ALL", "user"),
        rows("ssh_preauth_connection_closed_total", "counter", f"SELECT {ip_cols}, count(*) AS value FROM a"
             " WHERE kind = 'preauth_closed' GROUP BY ALL", "source_ip", "source_display"),
        rows("ssh_errors_total", "counter", _ERRORS, "error_type"),
        rows("ssh_failed_logins_total", "counter", f'SELECT u AS "user", {ip_cols}, count(*) AS value FROM f GROUP BY ALL', *us),
        rows("ssh_invalid_user_attempts_total", "counter",
             f'SELECT u AS "user", {ip_cols}, count(*) AS value FROM f WHERE inv GROUP BY ALL', *us),
        hist,
        rows("ssh_unique_users_total", "gauge", f"SELECT count(*) AS value FROM ({_US})"),
        rows("ssh_login_heatmap", "gauge", _HEAT, "day_of_week", "hour"),
    ]
    if not snapshots:
        all_rows = "\nUNION ALL ".join(parts)
        return _with(f"SELECT *, (SELECT max(ts) FROM a) AS sample_time FROM ({all_rows})", _EVENTS, _SESSIONS, _FAILED)
    parts += [rows("ssh_active_sessions", "gauge", _GAUGE, *us), rows("ssh_user_online", "gauge", _ONLINE, "user")]
    return _with("\nUNION ALL ".join(parts), _EVENTS, _SESSIONS, _FAILED, _WHO)


def _counters_sql() -> str:
    def part(metric, source, condition, **labels):
        columns = ", ".join(
            f"CAST({labels.get(c, 'NULL')} AS VARCHAR) AS \"{c}\""
            for c in ("user", "source_ip", "source_display", "auth_method", "error_type")
        )
        return f"SELECT '{metric}' AS metric, {columns} FROM {source} WHERE {condition}"

    source = {"source_ip": "ip", "source_display": "ip"}
    parts = [
        part("ssh_logins_total", "a", "kind = 'accepted'", user="u", auth_method="method", **source),
        part("ssh_logouts_total", "a", "kind = 'session_closed'", user="u"),
        part("ssh_preauth_connection_closed_total", "a", "kind = 'preauth_closed'", **source),
        part("ssh_errors_total", "a", "kind = 'port_forward_error'", error_type="'port_forward_failed'"),
        part("ssh_errors_total", "a", "kind = 'max_auth'", error_type="'max_auth_exceeded'"),
        part("ssh_failed_logins_total", "f", "true", user="u", **source),
        part("ssh_invalid_user_attempts_total", "f", "inv", user="u", **source),
    ]
    return _with(
        f"SELECT *, count(*) AS value FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL", _EVENTS, _FAILED
    )


_FIRST_DISPLAY = f"""SELECT ip AS value, {_display('name', 'ip')} AS display FROM (SELECT ip, name, seq,
  min(seq) OVER (PARTITION BY ip) AS first FROM (""" + _TTL.format(
    rows="SELECT ip, seq, ts FROM a WHERE kind IN ('accepted', 'invalid_user', 'failed_password', 'max_auth',"
         " 'preauth_closed')"
) + ")) WHERE seq = first"


def oracle_sql() -> dict[str, str]:
    sf, ff = (_EVENTS, _SESSIONS), (_EVENTS, _FAILED)
    counted = 'u AS "user", ip AS source_ip, ip AS source_display'
    opens = """SELECT 'host' AS host, pid, u AS "user", ip AS source_ip, '' AS source_hostname, ip AS source_display,
      method AS auth_method, port, ts AS login_time, seq AS open_seq FROM o"""
    logins_sql = f"SELECT {counted}, method AS auth_method, count(*) AS value FROM a WHERE kind = 'accepted' GROUP BY ALL"
    failed_sql = f"SELECT {counted}, count(*) AS value FROM f GROUP BY ALL"
    trimmed = "(SELECT * FROM s ORDER BY close_seq DESC LIMIT 600)"
    who_base = 'snapshot_id, line_no, u AS "user", tty, login_time, source'
    top = "SELECT {c}, count(*) AS sessions FROM ({t}) WHERE {c} <> '' GROUP BY {c} ORDER BY count(*) DESC, min(close_seq) LIMIT 20"
    return {
        "ingest_report": _with(
            """SELECT CASE WHEN dom = 31 THEN 'auth.log' ELSE 'auth.log.' || (31 - dom) END AS file_name,
            count(*) AS lines, count(*) FILTER (WHERE contains(line, 'sshd[')) AS auth_lines, 'unchecked' AS status
            FROM lines GROUP BY ALL""", _EVENTS, _TEXT),
        "ingest_files": _with(
            """SELECT file_name, CASE WHEN file_name <> 'auth.log.2.gz' THEN count(line) END AS lines,
            CASE WHEN file_name <> 'auth.log.2.gz' THEN count(*) FILTER (WHERE contains(line, 'sshd[')) END AS auth_lines,
            CASE WHEN file_name = 'auth.log.2.gz' THEN 'degraded' ELSE 'ok' END AS status
            FROM (SELECT CASE WHEN dom = 31 THEN 'auth.log' ELSE 'auth.log.' || (31 - dom) || CASE WHEN (31 - dom) % 2 = 0 THEN '.gz' ELSE '' END END
                    AS file_name, line FROM lines) GROUP BY file_name""", _EVENTS, _TEXT),
        "ingest_damage": _with(
            """SELECT name AS file_name, CASE WHEN state = 'ok' THEN (times * n)::BIGINT END AS lines,
            CASE WHEN state = 'ok' THEN (times * m)::BIGINT END AS auth_lines, state AS status
            FROM (VALUES ('auth.log.1.gz', 2, 'ok'), ('auth.log.2.gz', 0, 'degraded'), ('auth.log.3.gz', 0, 'degraded'),
                         ('auth.log.4.gz', 0, 'degraded'), ('auth.log.5', 0, 'ok'), ('auth.log.6.gz', 0, 'ok')) v(name, times, state),
                 (SELECT count(*) AS n, count(*) FILTER (WHERE contains(line, 'sshd[')) AS m FROM lines)""", _EVENTS, _TEXT),
        "scan_rotated": _with(
            """SELECT CASE WHEN dom = 31 THEN 'auth.log' ELSE 'auth.log.' || (31 - dom) || CASE WHEN (31 - dom) % 2 = 0 THEN '.gz' ELSE '' END END
            AS file_name, line AS value FROM lines WHERE dom <> 29""", _EVENTS, _TEXT),
        "parse_events": _with(
            """SELECT 'host' AS host, pid, kind, u AS "user", ip AS source_ip, port, method AS auth_method, inv AS invalid_user,
            fh AS fwd_host, fp AS fwd_port, a.ts, seq, line FROM a JOIN lines USING (seq)""", _EVENTS, _TEXT),
        "event_kind_counts": _with("SELECT kind, count(*) AS n FROM a GROUP BY kind", _EVENTS),
        "ev_accepted": _ev("accepted", 'u AS "user", ip AS source_ip, port, method AS auth_method'),
        "ev_opened": _ev("session_opened", 'u AS "user"'),
        "ev_closed": _ev("session_closed", 'u AS "user"'),
        "ev_invalid_user": _ev("invalid_user", 'u AS "user", ip AS source_ip'),
        "ev_failed_password": _ev("failed_password", 'u AS "user", ip AS source_ip, port, inv AS invalid_user'),
        "ev_preauth": _ev("preauth_closed", "ip AS source_ip, port"),
        "ev_port_forward": _ev("port_forward_error", "fh AS fwd_host, fp AS fwd_port"),
        "ev_max_auth": _ev("max_auth", 'u AS "user", ip AS source_ip, inv AS invalid_user'),
        "ts_inference": _with(
            "SELECT seq, ts AS ts_end, CASE WHEN ts > TIMESTAMP '2024-01-16 00:00:00' THEN ts - INTERVAL 1 YEAR"
            " ELSE ts END AS ts_mid FROM a", _EVENTS),
        "who_parse": _with(f"SELECT {who_base} FROM w", _EVENTS, _WHO),
        "who_remote": _with(f"SELECT {who_base} FROM act", _EVENTS, _WHO),
        "source_details": _with(
            "SELECT snapshot_id, line_no, source AS raw, display AS source, source AS source_ip,"
            " hostname AS source_hostname, display AS source_display FROM wd", _EVENTS, _WHO),
        "session_opens": _with(opens, *sf),
        "sessions": _with(f"SELECT {_SESSION_COLS} FROM s", *sf),
        "session_durations": _with('SELECT close_seq, u AS "user", secs AS duration_seconds FROM s', *sf),
        "open_sessions": _with(
            opens + " WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.pid = o.pid AND x.seq > o.seq"
            " AND x.kind IN ('session_opened', 'session_closed'))", *sf),
        "invalid_dedup": _with("SELECT seq, 'host' AS host, pid, u AS \"user\", ip AS source_ip, ts FROM counted", *ff),
        "invalid_port_backfill": _with(
            "SELECT seq, pid, full_port AS port FROM counted WHERE port = '' AND full_port <> ''", *ff),
        "failed_attempts": _with(f"SELECT {_FAILED_COLS} FROM f", *ff),
        "m_failed_raw": _with(failed_sql, *ff),
        "m_logins": _with(logins_sql, _EVENTS),
        "m_logins_full": _with(logins_sql, _EVENTS),
        "m_logouts": _with(
            "SELECT u AS \"user\", count(*) AS value FROM a WHERE kind = 'session_closed' GROUP BY ALL", _EVENTS),
        "m_failed": _with(failed_sql, *ff),
        "m_failed_bounded": _with(_labelled("f"), _EVENTS, _SESSIONS, _FAILED, _LABELS),
        "m_invalid": _with(f"SELECT {counted}, count(*) AS value FROM f WHERE inv GROUP BY ALL", *ff),
        "m_active": _with(_GAUGE, _EVENTS, _WHO),
        "m_unique_users": _with(f"SELECT count(*) AS value FROM ({_US})", _EVENTS),
        "m_duration_hist": _with(_HIST, *sf),
        "m_errors": _with(_ERRORS, _EVENTS),
        "m_preauth": _with(
            "SELECT ip AS source_ip, ip AS source_display, count(*) AS value FROM a"
            " WHERE kind = 'preauth_closed' GROUP BY ALL", _EVENTS),
        "m_heatmap": _with(_HEAT, _EVENTS),
        "m_user_online": _with(_ONLINE, _EVENTS, _WHO),
        "q_active_total": _with("SELECT CAST(count(*) AS BIGINT) AS value FROM now", _EVENTS, _WHO),
        "q_failed_1h": _with(
            "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,"
            " count(*) AS value FROM f GROUP BY ALL", *ff),
        "q_failed_1h_sliding": _with(
            """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS value FROM (
            SELECT unnest(range(0, 4)) AS k, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS w FROM f
            ) GROUP BY ALL""", *ff),
        "q_avg_duration_1h": _with(
            """SELECT u AS "user", date_trunc('hour', logout_time) AS window_start,
            date_trunc('hour', logout_time) + INTERVAL 1 HOUR AS window_end, sum(secs) / count(*) AS value
            FROM s WHERE secs >= 0 GROUP BY ALL""", *sf),
        "label_registry": _with("SELECT * FROM reg", _EVENTS, _SESSIONS, _FAILED, _LABELS),
        "label_display": _with(_FIRST_DISPLAY, _EVENTS, _PTR),
        "m_logins_full_pinned": _with(
            f"""SELECT u AS "user", ip AS source_ip, n.display AS source_display, method AS auth_method,
            count(*) AS value FROM a JOIN ({_FIRST_DISPLAY}) n ON n.value = a.ip WHERE kind = 'accepted' GROUP BY ALL""",
            _EVENTS, _PTR),
        "stream_sessions": _with(f"SELECT {_SESSION_COLS} FROM s", *sf),
        "stream_histogram": _with(_HIST, *sf),
        "stream_heatmap": _with(_HEAT, _EVENTS),
        "stream_unique_users": _with(f"SELECT count(*) AS value FROM ({_US})", _EVENTS),
        "stream_samples": _samples_sql(snapshots=False),
        "stream_events": _with(
            """SELECT seq, 'host' AS host, pid, kind, u AS "user", ip AS source_ip, port, ts FROM a""", _EVENTS),
        "stream_bounded": _with(f"SELECT {_SESSION_COLS} FROM s", _EVENTS, _SESSIONS.replace(
            "p.kind = 'accepted'", "p.kind = 'accepted' AND (SELECT (p.seq // 2 - lo) * 4 // n = (x.seq // 2 - lo) * 4 // n FROM span)"
        ).replace("\no AS (", "\nspan AS (SELECT min(event_id) AS lo, max(event_id) - min(event_id) + 1 AS n FROM events),\no AS (", 1)),
        "stream_failed": _with(f"SELECT {_FAILED_COLS} FROM f", *ff),
        "stream_counters": _counters_sql(),
        "stream_registry": _with("SELECT * FROM ranked", _EVENTS, _SESSIONS, _FAILED, _FULL_REGISTRY),
        "stream_active": _with(_GAUGE, _EVENTS, _WHO),
        "stream_online": _with(_ONLINE, _EVENTS, _WHO),
        "r_active": _with(f"SELECT {_WHO_COLS} FROM now", _EVENTS, _WHO),
        "r_history": _with(f"SELECT {_SESSION_COLS} FROM s ORDER BY close_seq DESC LIMIT 200", *sf),
        "r_failed": _with(f"SELECT {_FAILED_COLS} FROM f ORDER BY seq DESC LIMIT 200", *ff),
        "history_range": _with(
            f"SELECT {_SESSION_COLS} FROM s WHERE logout_time {_RANGE} ORDER BY close_seq DESC LIMIT 150", *sf),
        "failed_range": _with(f"SELECT {_FAILED_COLS} FROM f WHERE ts {_RANGE} ORDER BY seq DESC LIMIT 300", *ff),
        "history_json": _with(
            f"""SELECT CAST(to_json(struct_pack(host := host, pid := pid, "user" := u, source_ip := ip,
            source_hostname := '', source_display := ip, auth_method := method, port := port,
            login_time := strftime(login_time, '%Y-%m-%dT%H:%M:%S'),
            logout_time := strftime(logout_time, '%Y-%m-%dT%H:%M:%S'), duration_seconds := secs,
            open_seq := open_seq, close_seq := close_seq)) AS VARCHAR) AS value, close_seq
            FROM s ORDER BY close_seq DESC LIMIT 200""", *sf),
        "failed_json": _with(
            f"""SELECT CAST(to_json(struct_pack(timestamp := strftime(ts, '%Y-%m-%dT%H:%M:%S'), "user" := u, source_ip := ip,
            source_hostname := '', source_display := ip, port := port, type := type)) AS VARCHAR) AS value, seq
            FROM f ORDER BY seq DESC LIMIT 200""", *ff),
        "r_history_trimmed": _with(
            f"SELECT {_SESSION_COLS} FROM {trimmed} WHERE logout_time {_RANGE} ORDER BY close_seq DESC LIMIT 500", *sf),
        "r_summary": _with(
            f"""SELECT count(*) AS total_sessions, (SELECT count(*) FROM f) AS total_failed_attempts,
            (SELECT count(*) FROM ({_US})) AS unique_user_count,
            round(coalesce(avg(secs), 0), 1) AS average_session_duration_seconds FROM s""",
            _EVENTS, _SESSIONS, _FAILED),
        "r_logins_per_user": _with('SELECT u AS "user", count(*) AS logins FROM s GROUP BY u', *sf),
        "r_top_ips": _with(top.format(c="source_ip", t="SELECT ip AS source_ip, close_seq FROM s"), *sf),
        "r_top_sources": _with(
            top.format(c="source_display", t=f"SELECT {_display('n.name', 's.ip')} AS source_display, close_seq"
                       " FROM s LEFT JOIN newest n ON n.ip = s.ip"), _EVENTS, _SESSIONS, _PTR),
        "r_unique_users": _with(f'SELECT u AS "user" FROM ({_US}) ORDER BY 1', _EVENTS),
        "r_heatmap": _with(_cells("SELECT ts FROM a WHERE kind = 'accepted'"), _EVENTS),
        "r_heatmap_range": _with(_cells(f"SELECT ts FROM a WHERE kind = 'accepted' AND ts {_RANGE}"), _EVENTS),
        "r_users_status": _with(
            f"""SELECT k.u AS "user", CASE WHEN count(now.u) > 0 THEN 'Online' ELSE 'Offline' END AS status,
            count(now.u) AS sessions, coalesce(string_agg(DISTINCT display, ', ' ORDER BY display), '') AS sources
            FROM ({_US} UNION SELECT u FROM now) k LEFT JOIN now ON now.u = k.u GROUP BY k.u""", _EVENTS, _WHO),
        "enrich_hosts": _with(
            f"""SELECT ts AS timestamp, u AS "user", f.ip AS source_ip, coalesce(n.name, '') AS source_hostname,
            {_display('n.name', 'f.ip')} AS source_display, port, type, inv AS invalid_user, seq
            FROM f LEFT JOIN newest n ON n.ip = f.ip""", _EVENTS, _FAILED, _PTR),
        "enrich_hosts_ttl": _with(
            f"""SELECT seq, 'host' AS host, pid, ip AS source_ip, port, ts, name AS source_hostname,
            {_display('name', 'ip')} AS source_display FROM ("""
            + _TTL.format(rows="SELECT * FROM a WHERE kind = 'preauth_closed'") + ")", _EVENTS, _PTR),
        "metric_samples": _samples_sql(),
    }
