"""Lines, headers, sources, snapshots and files."""

import gzip
import ipaddress
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loginlake.functions.arguments import report_limit
from loginlake.functions.sources import add_source_details, is_ip_address
from loginlake.functions.timestamps import parse_time_argument, within
from loginlake.operators import enrich, failures, labels, metrics, sessions
from loginlake.operators.parse import is_recognised, parse_auth_events
from loginlake.operators.storage import own_folder
from loginlake.plans import catalog, reports, tables
from loginlake.sources import integrity, logs, who
from loginlake.sources.files import filesystem

AS_OF = "2026-03-20"


def events_of(spark, *lines, as_of=AS_OF, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "seq bigint, value string")
    return parse_auth_events(df, as_of, **options)


def head(text, pid=123, at="Mar  8 00:17:01"):
    return f"{at} host sshd[{pid}]: {text}"


OPENED = "pam_unix(sshd:session): session opened for user alice(uid=1000) by (uid=0)"


def test_auth_method_with_slash(spark):
    events = events_of(
        spark,
        head("Accepted keyboard-interactive/pam for alice from 10.0.0.1 port 2222 ssh2"),
        head(OPENED, at="Mar  8 00:17:02"),
    )
    row = sessions.open_sessions(events).first()
    assert (row.auth_method, row.user, row.source_ip) == ("keyboard-interactive/pam", "alice", "10.0.0.1")


@pytest.mark.parametrize("reverse", [False, True])
def test_doubled_invalid_user_counts_once(spark, reverse):
    lines = [
        head("Invalid user ghost from 10.0.0.1"),
        head("Failed password for invalid user ghost from 10.0.0.1 port 2222 ssh2"),
    ]
    rows = failures.failed_attempts(events_of(spark, *(lines[::-1] if reverse else lines))).collect()
    assert [(r.type, r.port) for r in rows] == [("invalid_user", "2222")]


def test_exceeded_attempts_of_an_invalid_user(spark):
    events = events_of(spark, head(
        "maximum authentication attempts exceeded for invalid user ghost from 10.0.0.1 port 2222 ssh2 [preauth]"))
    row = metrics.invalid_user_attempts(failures.failed_attempts(events)).first()
    assert tuple(row) == ("ghost", "10.0.0.1", "10.0.0.1", 1)


def test_overflow_labels(spark):
    events = events_of(
        spark,
        head("Failed password for alice from 10.0.0.1 port 2222 ssh2", 101),
        head("Failed password for bob from 10.0.0.2 port 2223 ssh2", 102),
    )
    registry = labels.label_registry(events, AS_OF, {"user": 1, "source_ip": 1})
    got = metrics.failed_logins(failures.failed_attempts(events), registry).collect()
    assert sorted(map(tuple, got)) == [
        ("__other__", "__other__", "__other__", 1), ("alice", "10.0.0.1", "10.0.0.1", 1)]


def test_caps_above_the_window_bound(spark):
    lines = [head(f"Failed password for u{i % 7} from 10.0.0.{i} port 1 ssh2") for i in range(20)]
    registry = labels.label_registry(events_of(spark, *lines), AS_OF, {"user": 5000, "source_ip": 6, "auth_method": 2})
    got = registry.rows.groupBy("dimension").count().collect()
    assert {r["dimension"]: r["count"] for r in got} == {"user": 7, "source_ip": 6}


def test_lines_that_are_not_events(spark):
    lines = [
        "Mar  8 00:17:01 host CRON[1]: pam_unix(cron:session): session opened for user root(uid=0)",
        "Mar  8 00:17:01 host sshd-session[1]: Accepted password for a from 10.0.0.1 port 1 ssh2",
        head("error: maximum authentication attempts exceeded for root from 10.0.0.1 port 1 ssh2 [preauth]"),
        head("Connection closed by authenticating user root 10.0.0.1 port 22 [preauth]"),
        head("Failed password for  from 10.0.0.1 port 22 ssh2"),
        head("Failed publickey for root from 10.0.0.1 port 22 ssh2"),
    ]
    assert events_of(spark, *lines).count() == 0


def test_first_pattern_wins_and_search_is_not_anchored(spark):
    both = head("Accepted password for a from 10.0.0.1 port 1 ssh2") + " sshd[9]: Invalid user b from 10.0.0.2"
    later = "x sshd[7]: nothing sshd[8]: Invalid user b from 10.0.0.2"
    rows = events_of(spark, both, later).orderBy("seq").collect()
    assert [(r.kind, r.pid, r.user) for r in rows] == [("accepted", "123", "a"), ("invalid_user", "8", "b")]


@pytest.mark.parametrize("end", ["", "(uid=0) by (uid=0)", " by (uid=0)"])
def test_opened_user_ends(spark, end):
    row = events_of(spark, head("pam_unix(sshd:session): session opened for user bob" + end)).first()
    assert (row.kind, row.user) == ("session_opened", "bob")


@pytest.mark.parametrize(
    "header,as_of,want",
    [
        ("Mar  8 00:17:01", "2026-03-20", datetime(2026, 3, 8, 0, 17, 1)),
        ("Mar 18 00:17:01", "2026-03-17 01:00:00", datetime(2026, 3, 18, 0, 17, 1)),
        ("Mar 18 02:17:01", "2026-03-17 01:00:00", datetime(2025, 3, 18, 2, 17, 1)),
        ("Dec 31 23:59:59", "2026-01-02", datetime(2025, 12, 31, 23, 59, 59)),
        ("mar 08 00:17:01", "2026-03-20", datetime(2026, 3, 8, 0, 17, 1)),
        ("Mar  8 00:17:60", "2026-03-20", None),
        ("Mar  8 24:00:00", "2026-03-20", None),
        ("Mar 32 00:17:01", "2026-03-20", None),
        ("Mar  0 00:17:01", "2026-03-20", None),
        ("arf  8 00:17:01", "2026-03-20", None),
        ("Feb 29 10:00:00", "2024-03-20", datetime(2024, 2, 29, 10)),
        ("Feb 29 10:00:00", "2025-03-20", datetime(2024, 2, 29, 10)),
        ("Feb 29 10:00:00", "2026-03-20", None),
    ],
)
def test_header_dates(spark, header, as_of, want):
    row = events_of(spark, head("Invalid user x from 10.0.0.1", at=header), as_of=as_of).first()
    assert row.ts == want


def test_leap_day_can_be_left_out(spark):
    line = head("Invalid user x from 10.0.0.1", at="Feb 29 10:00:00")
    assert events_of(spark, line, as_of="2024-03-20", leap_day=False).first().ts is None


def test_event_without_date_still_counts(spark):
    line = "2026-03-08T00:17:01+01:00 web1 sshd[5]: Accepted password for a from 10.0.0.1 port 1 ssh2"
    events = events_of(spark, line)
    row = events.first()
    assert (row.ts, row.host, row.kind) == (None, "web1", "accepted")
    assert metrics.logins(events).first().value == 1
    assert metrics.login_heatmap(events).agg(F.sum("value")).first()[0] == 0


def test_close_without_date_ends_at_the_clock(spark):
    events = events_of(
        spark, head(OPENED), "? sshd[123]: pam_unix(sshd:session): session closed for user alice"
    ).withColumn("host", F.lit("h"))
    row = sessions.sessions(events, "2026-03-08 00:18:01").first()
    assert (row.logout_time, row.duration_seconds) == (datetime(2026, 3, 8, 0, 18, 1), 60.0)


def test_addresses_as_the_standard_library_sees_them(spark):
    tokens = [
        "10.0.0.1", "010.0.0.1", "256.1.1.1", "1.2.3", "1.2.3.4.5", "0.0.0.0", "::", "::1", "1::", "fe80::1%eth0",
        "fe80::1%", "::ffff:192.168.1.20", "::ffff:1.2.3.256", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::",
        "1:2:3:4:5:6:1.2.3.4", "1::2::3", "12345::", ":1", "1:", "g::1", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7",
        "1::3:4:5:6:7:8", "host.example.com", "", "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6::1.2.3.4", "10.0.0.1%1", "::1/64",
    ]

    def known(token):
        try:
            ipaddress.ip_address(token)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("ip", F.expr(is_ip_address("t")))
    assert {r.t: r.ip for r in df.collect()} == {t: known(t) for t in tokens}


def test_source_details(spark):
    df = spark.createDataFrame(
        [(" 10.0.0.1 ", "Client.Example.com."), ("10.0.0.2", "10.0.0.2"), ("10.0.0.3", None),
         ("Client.Example.COM..", "x"), ("", "x"), (None, None)], "source string, ptr string")
    rows = add_source_details(df, "source", "ptr").collect()
    assert [(r.source_ip, r.source_hostname, r.source_display) for r in rows] == [
        ("10.0.0.1", "client.example.com", "client.example.com (10.0.0.1)"),
        ("10.0.0.2", "", "10.0.0.2"), ("10.0.0.3", "", "10.0.0.3"),
        ("Client.Example.COM..", "client.example.com", "client.example.com"), ("", "", ""), ("", "", ""),
    ]


WHO = [
    ("alice pts/0 2026-03-11 12:00 192.168.1.20", ("2026-03-11 12:00", "192.168.1.20")),
    ("bob pts/1 2026-03-11 12:05 :0", None),
    ("carol pts/2 2026-03-11 12:10", None),
    ("alice pts/0 Mar 11 12:00 (192.168.1.20)", ("Mar 11 12:00", "192.168.1.20")),
    ("bob pts/1 Mar 11 12:05 (:0)", None),
    ("alice pts/0 Mar 11 12:00", None),
    ("alice pts/0 Mar 11 12:00 host1 extra", ("Mar 11 12:00", "host1")),
    ("alice pts/0 2026-03-11 12:00 ::ffff:192.168.1.20", ("2026-03-11 12:00", "::ffff:192.168.1.20")),
    ("alice pts/0 2026-03-11 12:00 Client.Example.com", ("2026-03-11 12:00", "client.example.com")),
    ("alice pts/0 2026-03-11 12:00 (tmux(9).%0)", None),
    ("alice pts/0 2026-03-11 12:00 name)", None),
    ("alice pts/0 12:00", None),
    ("alice pts/0 2026-03-11 12:00 (:1.5)", None),
    ("  alice  pts/0 2026-03-11 12:00 (my host)", ("2026-03-11 12:00", "my host")),
]


def test_snapshot_lines(spark):
    df = spark.createDataFrame([("s", i, line) for i, (line, _) in enumerate(WHO)], "snapshot_id string, line_no bigint, value string")
    got = {r.line_no: (r.login_time, r.source) for r in who.active_sessions(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(WHO) if want}


def test_user_status_with_users_unknown_to_the_log(spark, tmp_path):
    (tmp_path / "s1").write_text("dave pts/3 2026-03-11 12:15 (192.168.1.30)\n")
    lines = who.read_snapshots(spark, str(tmp_path))
    known = spark.createDataFrame([("alice",)], "user string")
    active = who.active_sessions(lines)
    assert [tuple(r) for r in reports.users_status(known, active, lines).collect()] == [
        ("alice", "Offline", 0, ""), ("dave", "Online", 1, "192.168.1.30")]
    online = {r.user: r.value for r in metrics.user_online(known, active, lines).collect()}
    assert online == {"alice": 0, "dave": 1}
    assert metrics.active_session_gauge(active, lines).first().value == 1


def test_newest_snapshot_may_be_empty(spark):
    df = spark.createDataFrame(
        [("s1", 0, "dave pts/3 2026-03-11 12:15 (192.168.1.30)"), ("s2", 0, "bob tty1 2026-03-11 12:15")],
        "snapshot_id string, line_no bigint, value string")
    gauge = metrics.active_session_gauge(who.active_sessions(df), df).collect()
    assert [(r.user, r.value) for r in gauge] == [("dave", 0)]


def test_session_and_summary_with_host_names(spark):
    events = events_of(
        spark, head("Accepted publickey for alice from 10.0.0.1 port 2222 ssh2"),
        head(OPENED, at="Mar  8 00:17:02"),
        head("pam_unix(sshd:session): session closed for user alice", at="Mar  8 00:18:02"),
    )
    ptr = spark.createDataFrame([("10.0.0.1", "client.example.com", datetime(2026, 3, 8))], "ip string, hostname string, resolved_at timestamp_ntz")
    rows = enrich.enrich_hosts(sessions.sessions(events, AS_OF), ptr)
    row = reports.session_history(rows, 10).first()
    assert (row.source_hostname, row.source_display, row.duration_seconds) == (
        "client.example.com", "client.example.com (10.0.0.1)", 60.0)
    assert [tuple(r) for r in reports.top_values(rows, "source_display").collect()] == [("client.example.com (10.0.0.1)", 1)]
    # the same through enriched events
    early = sessions.sessions(enrich.enrich_hosts(events, ptr), AS_OF).first()
    assert early.source_display == "client.example.com (10.0.0.1)"


def test_lookup_lifetimes(spark):
    ptr = spark.createDataFrame(
        [("10.0.0.1", "a.", datetime(2026, 3, 8, 1)), ("10.0.0.1", "", datetime(2026, 3, 8, 1, 30))],
        "ip string, hostname string, resolved_at timestamp_ntz")
    at = [datetime(2026, 3, 8, 0, 59, 59), datetime(2026, 3, 8, 1), datetime(2026, 3, 8, 1, 29, 59), datetime(2026, 3, 8, 1, 30), datetime(2026, 3, 8, 1, 40)]
    df = spark.createDataFrame([("10.0.0.1", t) for t in at], "source_ip string, ts timestamp_ntz")
    got = enrich.enrich_hosts_ttl(df, ptr).orderBy("ts").collect()
    assert [r.source_hostname for r in got] == ["", "a", "a", "", ""]


def test_top_values_ties_and_cut(spark):
    rows = [("", 0)] + [(f"s{i:02d}", 100 - i) for i in range(25)] + [("s24", 200)]
    df = spark.createDataFrame(rows, "source_ip string, close_seq bigint")
    got = [r.source_ip for r in reports.top_values(df, "source_ip").collect()]
    assert got == ["s24"] + [f"s{i:02d}" for i in range(23, 4, -1)]


def test_ranges_and_limits(spark):
    rows = [(datetime(2026, 3, 1), "old", 1), (datetime(2026, 3, 5, 12), "mid", 2), (datetime(2026, 3, 9, 12), "new", 3), (None, "none", 4)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, user string, seq bigint")
    users = lambda *a, **k: [r.user for r in reports.failed_history(df, *a, **k).collect()]
    assert users(1, "2026-03-04T00:00:00", "2026-03-10T00:00:00") == ["new"]
    assert users() == ["none", "new", "mid", "old"]
    assert users(start="2026-03-05T12:00:00", end="2026-03-09T12:00:00Z") == ["new", "mid"]
    assert users(max_history=3, end="2026-03-06") == ["mid"]
    assert within(df, F.col("timestamp")).count() == 4


def test_arguments():
    assert report_limit() == 200 and report_limit("9000") == 5000 and report_limit(7, None) == 7
    for bad in (0, -1, "x"):
        with pytest.raises(ValueError):
            report_limit(bad)
    assert parse_time_argument("2026-03-01T10:00:00+02:00", "UTC") == datetime(2026, 3, 1, 8)
    assert parse_time_argument(" 2026-03-01T10:00:00Z ", "Europe/Berlin") == datetime(2026, 3, 1, 11)
    assert parse_time_argument("2026-03-01") == datetime(2026, 3, 1)
    with pytest.raises(ValueError):
        parse_time_argument("yesterday")


def test_heatmap_range(spark):
    rows = [("accepted", datetime(2026, 3, 1, 10), 1), ("accepted", datetime(2026, 3, 5, 12), 2)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp_ntz, seq bigint")
    got = reports.heatmap(df, "2026-03-04T00:00:00", "2026-03-06T00:00:00").collect()
    assert [r.day for r in got] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert {r.day: r["12"] for r in got}["Thu"] == 1 and sum(r["10"] for r in got) == 0
    assert sum(r["10"] for r in reports.heatmap(df).collect()) == 1


def test_negative_durations(spark):
    events = events_of(
        spark, head(OPENED, at="Mar  8 00:17:02"),
        head("pam_unix(sshd:session): session closed for user alice", at="Mar  8 00:17:00"),
        head(OPENED, 5), head("pam_unix(sshd:session): session closed for user alice", 5, at="Mar  8 00:17:11"),
    )
    rows = sessions.sessions(events, AS_OF)
    failed, users = failures.failed_attempts(events), metrics.unique_users(events)
    assert tuple(reports.summary(rows, failed, users).first()) == (2, 0, 1, 4.0)
    count = metrics.duration_histogram(rows).filter("series = 'count'").first()
    assert count.value == 1.0
    nothing = rows.filter("false")
    assert reports.summary(nothing, failed, users).first().average_session_duration_seconds == 0.0


def test_rotated_files_in_arrival_order(spark, tmp_path):
    """Many blocks per file, gzip, numeric ranks, and names that do not belong."""
    files = {"auth.log.10.gz": 30, "auth.log.2": 400, "auth.log.1": 300, "auth.log": 500, "auth.log.old": 5}
    number, want = 0, []
    for name in ("auth.log.old", "auth.log.10.gz", "auth.log.2", "auth.log.1", "auth.log"):
        lines = [head(f"Invalid user u{number + i} from 10.0.0.1", i) for i in range(files[name])]
        want += [f"u{number + i}" for i in range(files[name])]
        number += files[name]
        data = ("\n".join(lines) + "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    (tmp_path / "auth.log-20260301").write_text(head("Invalid user no from 10.0.0.1") + "\n")
    (tmp_path / "other.log").write_text(head("Invalid user no from 10.0.0.1") + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = logs.read_logs(spark, str(tmp_path))
        events = parse_auth_events(lines, AS_OF)
        assert lines.rdd.getNumPartitions() > 20
        assert [r.user for r in events.orderBy("seq").collect()] == want
        newest = reports.failed_history(failures.failed_attempts(events), 3).collect()
        assert [r.user for r in newest] == want[:-4:-1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_damaged_and_missing_files(spark, tmp_path):
    good = "".join(head(f"Invalid user u{i} from 10.0.0.1") + "\n" for i in range(20))
    (tmp_path / "auth.log").write_text(good)
    noise = "".join(head(f"Invalid user {i * 7919 % 100003} from 10.0.{i % 251}.1") + "\n" for i in range(20000))
    whole = gzip.compress(noise.encode())
    (tmp_path / "auth.log.1.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "auth.log.2.gz").write_bytes(b"this is not gzip")
    lines = logs.read_logs(spark, str(tmp_path))
    report = logs.ingest_report(lines, is_recognised("value"), logs.list_logs(spark, str(tmp_path)))
    rows = {r.file_name: r for r in report.collect()}
    assert rows["auth.log"].lines == rows["auth.log"].auth_lines == 20 and rows["auth.log"].status == "ok"
    assert rows["auth.log.1.gz"].lines > 100 and rows["auth.log.1.gz"].status == "degraded"
    assert (rows["auth.log.2.gz"].lines, rows["auth.log.2.gz"].status) == (0, "degraded")
    status = logs.ingest_status(report).first()
    assert (status.status, status.files) == ("degraded", 3) and status.first_failed.endswith("/auth.log.1.gz")
    with pytest.raises(Exception):
        logs.read_logs(spark, str(tmp_path), tolerant=False).count()


def test_first_sightings_are_hashed(spark, tmp_path):
    """No sort over raw rows: compound orders are compared after the rows of a file block became one."""
    for name, users in (("auth.log.1", "cba"), ("auth.log", "abcd")):
        (tmp_path / name).write_text("".join(head(f"Accepted password for {u} from 10.0.0.1 port 1 ssh2") + "\n" for u in users))
    events = parse_auth_events(logs.read_logs(spark, str(tmp_path)), AS_OF)
    for with_display in (False, True):
        firsts = labels._first_seen(labels.log_sightings(events, AS_OF), with_display)
        plan = firsts._jdf.queryExecution().sparkPlan().toString().splitlines()
        kinds = [line.split("(")[0].strip(" :+-") for line in plan if "Aggregate(" in line]
        assert "HashAggregate" in kinds and "SortAggregate" not in kinds[kinds.index("HashAggregate"):]
        assert "ObjectHashAggregate" not in kinds
    registry = labels.label_registry(events, AS_OF).rows.filter("dimension = 'user'")
    assert [r.value for r in registry.orderBy("position").collect()] == ["c", "b", "a", "d"]


def test_a_cluster_names_its_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            own_folder(master)
    assert own_folder("local[8]") != own_folder("local")


def test_gzip_in_pieces():
    """Members, padding and damage at every cut of the data into pieces; large zeros inflate in bounds."""
    one = gzip.compress(b"line\n" * 1000)
    cases = [
        (one, True), (one + one, True), (one + bytes(700), True), (one + bytes(9) + one, True), (b"", True),
        (gzip.compress(b""), True), (one[:-1], False), (one[:20], False), (one + one[:-1], False), (one + b"x", False),
        (b"no gzip", False), (one[:30] + b"\xff\xff\xff" + one[33:], False), (bytes(3), False),
        (gzip.compress(bytes(9_000_000)), True),
    ]
    for data, whole in cases:
        for size in (1, 7, len(one), 1 << 20):
            pieces = [data[k:k + size] for k in range(0, len(data), size)]
            assert integrity.gzip_is_whole(pieces) is whole, (data[:20], len(data), size)


def test_empty_and_odd_files(spark, tmp_path):
    home = tmp_path / "a host [1]%"
    home.mkdir()
    (home / "auth.log").write_text(head("Invalid user kim from 10.1.0.1") + "\n")
    (home / "auth.log.1").write_text("")
    (home / "auth.log.2.gz").write_bytes(b"")
    (home / "auth.log.3.gz").write_bytes(gzip.compress(b""))
    (home / "other").write_text("x")
    lines = logs.read_logs(spark, str(tmp_path), recursive=True)
    files = logs.list_logs(spark, str(tmp_path), recursive=True)
    report = logs.ingest_report(lines, is_recognised("value"), files).collect()
    assert {r.file_name: (r.lines, r.status) for r in report} == {
        "auth.log": (1, "ok"), "auth.log.1": (0, "ok"), "auth.log.2.gz": (0, "ok"), "auth.log.3.gz": (0, "ok")}
    assert integrity.file_state(*filesystem(str(home / "gone.gz"))) == "unreadable"


def test_damage_is_made_of_all_lines(spark, tmp_path):
    """Every day of the table, whatever the number of files its lines fill; an empty table gives one empty file."""
    days = [datetime(2024, 1, d, 12) for d in (3, 4, 27, 30, 31)]
    # an odd purchase is one line, a signup whose id no 7 divides two, an odd view a line of another daemon
    rows = [(n, n % 9, kind, days[n % 5]) for n, kind in ((2 * k + 1, ("purchase", "signup", "view")[k % 3]) for k in range(300))]
    auth = sum({"purchase": 1, "signup": 1 + (n % 7 > 0), "view": int(n % 4 > 1)}[kind] for n, _, kind, _ in rows)
    cron = sum(kind == "view" and n % 4 == 1 for n, _, kind, _ in rows)
    table = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    for name, adaptive, n in (("one", "true", 1), ("several", "false", 1), ("none", "true", 0)):
        (table if n else table.limit(0)).write.parquet(f"{tmp_path}/{name}/events.parquet")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = catalog.queries()["ingest_damage"](spark, f"{tmp_path}/{name}").collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", before)
        assert sorted(map(tuple, got)) == [
            ("auth.log.1.gz", 2 * n * (auth + cron), 2 * n * auth, "ok"), *[(f"auth.log.{k}.gz", None, None, "degraded") for k in (2, 3, 4)],
            ("auth.log.5", 0, 0, "ok"), ("auth.log.6.gz", 0, 0, "ok")]


def test_hosts_with_equal_file_names_stay_apart(spark, tmp_path):
    good = gzip.compress((head("Invalid user kim from 10.1.0.1") + "\n").encode())
    for host, data in (("h1", good + good), ("h2", good[:-3]), ("h3", b"no gzip at all")):
        (tmp_path / host).mkdir()
        (tmp_path / host / "auth.log.1.gz").write_bytes(data)
    lines = logs.read_logs(spark, str(tmp_path), recursive=True)
    report = logs.ingest_report(lines, is_recognised("value"), logs.list_logs(spark, str(tmp_path), recursive=True))
    rows = {r.file_path.split("/")[-2]: r for r in report.collect()}
    assert {h: r.status for h, r in rows.items()} == {"h1": "ok", "h2": "degraded", "h3": "degraded"}
    assert rows["h1"].lines == 2
    assert logs.ingest_status(report).first().first_failed.endswith("h2/auth.log.1.gz")


def test_range_reports_read_their_days_only(spark, tmp_path):
    events = parse_auth_events(derived_lines(spark), "2024-02-01")
    paths = [str(tmp_path / n) for n in ("events", "sessions", "failed")]
    tables.save_events(events, paths[0])
    tables.save_correlated(spark, *paths, "2024-02-01")
    stored, rows, failed = (spark.read.parquet(p) for p in paths)
    bounds = ("2024-01-10T00:00:00", "2024-01-12T12:00:00Z")
    for report in (
        reports.session_history(rows, None, *bounds),
        reports.failed_history(failed, None, *bounds),
        reports.heatmap(stored, *bounds),
    ):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "event_date" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert report.count() > 0


def derived_lines(spark):
    from loginlake.sources import derived

    return derived.log_lines(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))


def test_no_logs_is_degraded(spark, tmp_path):
    (tmp_path / "unrelated").write_text("x\n")
    lines = logs.read_logs(spark, str(tmp_path))
    report = logs.ingest_report(lines, is_recognised("value"), logs.list_logs(spark, str(tmp_path)))
    assert logs.ingest_status(report).first().status == "degraded"


def test_saved_tables_and_sinks(spark, tmp_path):
    events = events_of(
        spark, head("Accepted publickey for alice from 10.0.0.1 port 2222 ssh2"), head(OPENED),
        head("pam_unix(sshd:session): session closed for user alice", at="Mar  8 00:18:01"),
        "no date sshd[9]: Invalid user ghost from 10.0.0.9",
    )
    paths = [str(tmp_path / n) for n in ("events", "sessions", "failed", "samples", "json")]
    tables.save_events(events, paths[0])
    tables.save_correlated(spark, *paths[:3], AS_OF)
    stored, rows, failed = (spark.read.parquet(p) for p in paths[:3])
    assert (stored.count(), rows.count(), failed.count()) == (4, 1, 1)
    registry = labels.label_registry(stored, AS_OF)
    tables.append_samples(metrics.metric_samples(stored, rows, failed, registry), paths[3])
    samples = spark.read.parquet(paths[3])
    login = samples.filter("metric = 'ssh_logins_total'").first()
    assert (login.type, login.value) == ("counter", 1.0)
    assert login.labels == {"user": "alice", "source_ip": "10.0.0.1", "source_display": "10.0.0.1", "auth_method": "publickey"}
    assert samples.filter("metric = 'ssh_unique_users_total'").first().labels == {}
    assert samples.filter("metric = 'ssh_session_duration_seconds_bucket'").count() == 10
    tables.save_json(reports.failed_history(failed).drop("event_date", "seq"), paths[4])
    assert [r.value for r in spark.read.text(paths[4]).collect()] == [
        '{"timestamp":null,"user":"ghost","source_ip":"10.0.0.9","source_hostname":"","source_display":"10.0.0.9",'
        '"port":"","type":"invalid_user","invalid_user":true}']


def test_declared_layouts(spark):
    """Jobs give exactly the declared columns and types."""
    from loginlake import schemas

    def layout(schema):
        return [(f.name, f.dataType) for f in schema]

    events = events_of(spark, head(OPENED))
    assert layout(events.schema) == layout(schemas.auth_events())
    assert layout(sessions.sessions(events, AS_OF).schema) == layout(schemas.sessions())
    assert layout(failures.failed_attempts(events).schema) == layout(schemas.failed_attempts())
    lines = spark.createDataFrame([], "snapshot_id string, line_no bigint, value string")
    assert layout(who.active_sessions(lines).schema) == layout(schemas.ACTIVE_SESSIONS)
    ptr = spark.createDataFrame([], schemas.PTR)
    named = enrich.enrich_hosts(sessions.sessions(events, AS_OF), ptr)
    assert sorted(named.columns) == sorted(schemas.sessions().fieldNames())
    files = events.withColumn("seq", F.lit(None).cast(schemas.FILE_SEQ))
    assert layout(sessions.sessions(files, AS_OF).schema) == layout(schemas.sessions(schemas.FILE_SEQ))
    samples = metrics.metric_samples(events, sessions.sessions(events, AS_OF), failures.failed_attempts(events))
    assert layout(samples.schema) == layout(schemas.METRIC_SAMPLES)


def test_session_json_holds_the_whole_row(spark):
    row = {
        "host": "h", "pid": "7", "user": "u", "source_ip": "", "source_hostname": "", "source_display": "", "auth_method": "",
        "port": "", "login_time": None, "logout_time": datetime(2026, 3, 8, 1, 2, 3), "duration_seconds": 1.0,
        "open_seq": 4, "close_seq": 9,
    }
    types = {"logout_time": "timestamp_ntz", "login_time": "timestamp_ntz", "duration_seconds": "double", "open_seq": "bigint", "close_seq": "bigint"}
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {types.get(c, 'string')}" for c in row))
    got = reports.session_json(rows).first()
    assert json.loads(got.value) == row | {"logout_time": "2026-03-08T01:02:03"} and got.close_seq == 9
    assert list(json.loads(reports.session_json(rows, reports.SESSION_FIELDS).first().value)) == list(reports.SESSION_FIELDS)
