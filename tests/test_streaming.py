"""Micro-batches give what one run over the whole log gives."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from loginlake.operators import failures, labels, metrics, sessions
from loginlake.operators.parse import parse_auth_events
from loginlake.sources import derived
from loginlake.sources.who import active_sessions
from loginlake.streaming.ingest import AuthLogStream, read_segments
from loginlake.streaming.registry import SharedRegistry
from loginlake.streaming.snapshots import SnapshotStream, read_snapshot_stream

AS_OF = "2024-02-01"
EVENTS = "/root/testdata/sf0.001/events.parquet"
CAPS = {"user": 12, "source_ip": 10, "auth_method": 1}


def place(path, name, lines, age):
    """Moves a finished segment in, as the contract asks."""
    hidden = path / f".{name}"
    hidden.write_text("".join(line + "\n" for line in lines))
    os.utime(hidden, (1_700_000_000 + age, 1_700_000_000 + age))
    hidden.rename(path / name)


@pytest.fixture(scope="module")
def log(spark):
    lines = derived.log_lines(spark.read.parquet(EVENTS))
    return [r.value for r in lines.orderBy("seq").collect()]


def bag(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def whole_log(spark, log):
    return parse_auth_events(spark.createDataFrame(list(enumerate(log)), "seq bigint, value string"), AS_OF).cache()


ATTEMPT = ("timestamp", "user", "source_ip", "port", "type", "invalid_user")


def test_stream_equals_batch(spark, log, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    cuts = [0, 301, 302, 640, 900, len(log)]
    stream = AuthLogStream(spark, str(tmp_path / "out"), AS_OF, caps=CAPS)
    # restarts: only new segments are read; some runs of the second query see several batches of the first
    for group in ((0, 1), (2,), (3,), (4,)):
        for n in group:
            place(landing, f"seg-{n}", log[cuts[n]:cuts[n + 1]], n)
        stream.run(read_segments(spark, str(landing), max_files=1))

    events = whole_log(spark, log)
    columns = ("host", "pid", "kind", "user", "source_ip", "port", "auth_method", "invalid_user", "ts")
    assert bag(stream.events.read(), *columns) == bag(events, *columns)

    columns = ("pid", "user", "source_ip", "auth_method", "port", "login_time", "logout_time", "duration_seconds")
    assert bag(stream.sessions, *columns) == bag(sessions.sessions(events, AS_OF), *columns)
    columns = ("pid", "user", "login_time")
    assert bag(stream.open_sessions(), *columns) == bag(sessions.open_sessions(events), *columns)

    failed = failures.failed_attempts(events)
    assert bag(stream.all_attempts(), *ATTEMPT) == bag(failed, *ATTEMPT)

    registry = labels.label_registry(events, AS_OF, CAPS).stored()
    columns = ("dimension", "value", "display", "position")
    assert bag(stream.label_registry().rows, *columns) == bag(registry.rows, *columns)

    counters = stream.counts()
    for metric, want in (
        ("ssh_logins_total", metrics.logins(events, registry)),
        ("ssh_logouts_total", metrics.logouts(events, registry)),
        ("ssh_errors_total", metrics.errors(events)),
        ("ssh_failed_logins_total", metrics.failed_logins(failed, registry)),
        ("ssh_invalid_user_attempts_total", metrics.invalid_user_attempts(failed, registry)),
    ):
        assert bag(counters.filter(F.col("metric") == metric), *want.columns) == bag(want, *want.columns)


def line(pid, second, text):
    return f"Jan  1 00:00:{second:02d} host sshd[{pid}]: {text}"


def test_a_batch_touches_its_own_keys(spark, tmp_path):
    """A thousand rows of one process id between others: a few edges reach the state, for one key."""
    landing = tmp_path / "in"
    landing.mkdir()
    first = [line(p, 0, f"Accepted password for u{p} from 10.0.0.1 port 1 ssh2") for p in range(50)]
    hot = [line(7, 1, "pam_unix(sshd:session): session opened for user u7(uid=1) by (uid=0)")]
    for k in range(500):
        hot.append(line(7, 2, "pam_unix(sshd:session): session closed for user u7"))
        hot.append(line(7, 3, "pam_unix(sshd:session): session opened for user u7(uid=1) by (uid=0)"))
        hot.append(line(7, 3, "Invalid user ghost from 10.0.0.9"))
    stream = AuthLogStream(spark, str(tmp_path / "out"), AS_OF)
    place(landing, "seg-0", first, 0)
    stream.run(read_segments(spark, str(landing)))
    place(landing, "seg-1", hot, 1)
    stream.run(read_segments(spark, str(landing)))
    edges = spark.read.parquet(f"{stream.edges}/{1:010d}").filter("part <> 'batch'")
    assert {r.pid for r in edges.collect()} == {"7"} and edges.count() < 10
    assert stream.sessions.count() == 500
    assert stream.sessions.filter("source_ip = '10.0.0.1'").count() == 1
    assert {r.pid for r in stream.state("accept").collect()} == {str(p) for p in range(50)} - {"7"}
    assert stream.all_attempts().count() == 250


def test_repetition_two_batches_later(spark, tmp_path):
    """A held report gets its port from a report two micro-batches on; other process ids change nothing."""
    landing = tmp_path / "in"
    landing.mkdir()
    lots = [
        [line(1, 0, "Invalid user ghost from 10.0.0.1"), line(2, 0, "Invalid user ghost from 10.0.0.1")],
        [line(3, 1, "Invalid user ghost from 10.0.0.1")],
        [line(1, 2, "Failed password for invalid user ghost from 10.0.0.1 port 4711 ssh2")],
        [line(1, 3, "Invalid user ghost from 10.0.0.1"), line(2, 3, "Failed password for invalid user other from 10.0.0.1 port 5 ssh2")],
    ]
    stream = AuthLogStream(spark, str(tmp_path / "out"), AS_OF)
    written = []
    for n, lot in enumerate(lots):
        place(landing, f"seg-{n}", lot, n)
        stream.run(read_segments(spark, str(landing)))
        written.append(sorted((r.user, r.port) for r in stream.failed_attempts().collect()))
    assert written == [[], [], [("ghost", "4711")], [("ghost", ""), ("ghost", "4711")]]
    events = whole_log(spark, sum(lots, []))
    assert bag(stream.all_attempts(), *ATTEMPT) == bag(failures.failed_attempts(events), *ATTEMPT)
    counters = {r.metric: r.n for r in stream.counts().groupBy("metric").agg(F.sum("value").alias("n")).collect()}
    assert counters["ssh_failed_logins_total"] == stream.all_attempts().count() == 5


def test_repeated_batch_changes_nothing(spark, log, tmp_path):
    """A micro-batch run again after a failure leaves the tables and the edges as they were."""
    stream = AuthLogStream(spark, str(tmp_path / "out"), AS_OF)
    lines = spark.createDataFrame(list(enumerate(log[:400])), "seq bigint, value string")
    stream.process(lines, 0)
    before = {f.name for f in (tmp_path / "out" / "edges").rglob("*.parquet")}
    stream.process(lines, 0)
    assert {f.name for f in (tmp_path / "out" / "edges").rglob("*.parquet")} == before
    assert stream.events.read().count() == whole_log(spark, log[:400]).count()


def test_running_counters_in_the_state_store(spark, log, tmp_path):
    """The one-pass counters are an ordinary streaming aggregation."""
    landing = tmp_path / "in"
    landing.mkdir()
    place(landing, "seg-0", log[:500], 0)
    place(landing, "seg-1", log[500:], 1)
    lines = read_segments(spark, str(landing), max_files=1).withColumn("seq", F.lit(0))
    counters = metrics.event_counters(parse_auth_events(lines, AS_OF))
    query = (
        counters.writeStream.format("memory").queryName("counters").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    whole = spark.createDataFrame(list(enumerate(log)), "seq bigint, value string")
    want = metrics.event_counters(parse_auth_events(whole, AS_OF))
    assert bag(spark.table("counters"), *want.columns) == bag(want, *want.columns)


def test_age_limit(spark, tmp_path):
    """With the shortest age an accept serves its own batch only, and a report is written one batch on."""
    landing = tmp_path / "in"
    landing.mkdir()
    opened = "pam_unix(sshd:session): session opened for user u(uid=1) by (uid=0)"
    closed = "pam_unix(sshd:session): session closed for user u"
    accepted = "Accepted password for u from 10.0.0.1 port 1 ssh2"
    failed = "Failed password for invalid user g from 10.0.0.1 port 9 ssh2"
    lots = [
        [line(1, 0, accepted), line(2, 0, accepted), line(2, 1, opened), line(5, 0, "Invalid user g from 10.0.0.1")],
        [line(1, 2, opened), line(9, 2, "Invalid user h from 10.0.0.1")],
        [line(1, 3, closed), line(2, 3, closed), line(5, 3, failed)],
    ]
    stream = AuthLogStream(spark, str(tmp_path / "out"), AS_OF, max_age="1 MILLISECOND")
    for n, lot in enumerate(lots):
        place(landing, f"seg-{n}", lot, n)
        stream.run(read_segments(spark, str(landing)))
    assert {r.pid: r.source_ip for r in stream.sessions.collect()} == {"1": "", "2": "10.0.0.1"}
    got = sorted((r.user, r.port) for r in stream.all_attempts().collect())
    assert got == [("g", ""), ("g", "9"), ("h", "")]
    assert ("h", "") in [(r.user, r.port) for r in stream.failed_attempts().collect()]


def test_snapshot_gauges_stay(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    snapshots = {
        "s1": ["alice pts/0 2026-03-11 12:00 192.168.1.20", "bob pts/1 2026-03-11 12:05 192.168.1.21"],
        "s2": ["alice pts/0 2026-03-11 12:00 192.168.1.20", "alice pts/3 2026-03-11 12:09 192.168.1.20"],
        "s3": ["carol pts/2 2026-03-11 12:10 (10.0.0.9)"],
    }
    for age, (name, lines) in enumerate(snapshots.items()):
        place(landing, name, lines, age)
    known = spark.createDataFrame([("dave",)], "user string")
    empty = spark.createDataFrame([], "dimension string, value string, display string, position int")
    stream = SnapshotStream(spark, str(tmp_path / "out"), labels.LabelRegistry(empty), known)
    stream.start(read_snapshot_stream(spark, str(landing), max_files=1)).awaitTermination(300)

    rows = [(s, n, v) for s, lines in snapshots.items() for n, v in enumerate(lines)]
    lines = spark.createDataFrame(rows, "snapshot_id string, line_no bigint, value string")
    active = active_sessions(lines)
    columns = ("user", "source_ip", "source_display", "value")
    assert bag(stream.active.after(2), *columns) == bag(metrics.active_session_gauge(active, lines), *columns)
    online = metrics.user_online(known, active, lines)
    assert bag(stream.online.after(2), "user", "value") == bag(online, "user", "value")
    assert {r.user: r.value for r in online.collect()} == {"alice": 0, "bob": 0, "carol": 1, "dave": 0}


def test_snapshot_caps_and_users_hold_in_every_batch(spark, tmp_path):
    """Caps of the given registry over three batches; users known later get a row."""
    landing = tmp_path / "in"
    landing.mkdir()
    for n, user in enumerate(("ann", "bob", "cat")):
        place(landing, f"who-{n}", [f"{user} pts/0 2026-03-1{n} 12:00 (10.2.0.{n + 1})"], n)
    known = iter([["ann"], ["ann", "dan"], ["ann", "dan", "eve"]])
    caps = {"user": 1, "source_ip": 1, "auth_method": 1}
    empty = spark.createDataFrame([], "dimension string, value string, display string, position int")
    stream = SnapshotStream(
        spark,
        str(tmp_path / "out"),
        registry=labels.LabelRegistry(empty, caps),
        known_users=lambda: spark.createDataFrame([(u,) for u in next(known)], "user string"),
    )
    query = stream.start(read_snapshot_stream(spark, str(landing), max_files=1))
    query.awaitTermination(300)
    assert query.exception() is None
    online = {r.user: r.value for r in stream.online.after(2).collect()}
    assert online == {"ann": 0, "__other__": 1}
    named = {(r.user, r.source_ip): r.value for r in stream.active.after(2).collect()}
    assert named == {("ann", "10.2.0.1"): 0, ("__other__", "__other__"): 1}


def test_one_registry_for_both_streams(spark, tmp_path):
    """Caps 1/1/1 over mixed batches: one name per dimension in both outputs; a repeated batch changes nothing."""
    names = SharedRegistry(spark, str(tmp_path / "names"), {"user": 1, "source_ip": 1, "auth_method": 1})
    logs = AuthLogStream(spark, str(tmp_path / "log"), AS_OF, registry=names)
    snapshots = SnapshotStream(spark, str(tmp_path / "who"), registry=names)
    (tmp_path / "in").mkdir()
    accepted = "Accepted {} for {} from 10.0.0.{} port 1 ssh2"
    for n, (user, seen) in enumerate((("ann", "bob"), ("bob", "ann"), ("cat", "dan"))):
        who = spark.createDataFrame([(f"s{n}", 0, f"{seen} pts/0 2026-03-1{n} 12:00 (10.2.0.{n + 1})")], "snapshot_id string, line_no bigint, value string")
        if n == 0:  # a snapshot comes first
            snapshots.process(who, n)
        place(tmp_path / "in", f"seg-{n}", [line(n, 0, accepted.format(f"m{n}", user, n))], n)
        logs.run(read_segments(spark, str(tmp_path / "in")))
        if n > 0:
            snapshots.process(who, n)
            snapshots.process(who, n)
    rows = {(r.dimension, r.value) for r in names.latest().rows.collect()}
    assert rows == {("user", "bob"), ("source_ip", "10.2.0.1"), ("auth_method", "m0")}
    counted = {(r.user, r.source_ip, r.auth_method): r.value for r in logs.counts().collect()}
    assert counted == {("__other__", "__other__", "m0"): 1, ("bob", "__other__", "__other__"): 1, ("__other__", "__other__", "__other__"): 1}
    assert {(r.user, r.source_ip) for r in snapshots.active.after(2).collect()} == {("bob", "10.2.0.1"), ("__other__", "__other__")}
    assert len(names._versions()) == 2


def test_a_segment_read_by_one_task_is_parsed_by_several(spark, log, tmp_path):
    """A gzip file is one task's to read; its lines are dealt out and keep their order."""
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "seg-0.gz").write_bytes(gzip.compress("".join(text + "\n" for text in log).encode()))
    stream = AuthLogStream(spark, str(tmp_path / "out"), AS_OF)
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions are not put together again
    spark.conf.set(name, "false")
    try:
        query = stream.ingest(read_segments(spark, str(landing)), {"availableNow": True})
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.unset(name)
    events = stream.events.read_batch(0)
    assert len(events.inputFiles()) > 1
    columns = ("host", "pid", "kind", "user", "source_ip", "port", "auth_method", "invalid_user", "ts")
    want = whole_log(spark, log)
    assert [r[:] for r in events.orderBy("seq").select(*columns).collect()] == [r[:] for r in want.orderBy("seq").select(*columns).collect()]
