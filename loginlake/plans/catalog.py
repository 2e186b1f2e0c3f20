"""Registered queries: each reads the given tables and runs over all their rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sources import add_source_details, is_remote
from ..operators import enrich, failures, labels, metrics, sessions as correlation
from ..operators.parse import events_of, is_recognised, parse_auth_events
from ..operators.storage import checkpoint_folder
from ..sources import derived, logs, rotated, who
from ..streaming.ingest import AuthLogStream
from ..streaming.snapshots import SnapshotStream
from . import reports

AS_OF = "2024-02-01"
# fixed report range of the range queries
START, END = "2024-01-10T00:00:00", "2024-01-20T12:00:00Z"
SMALL_CAPS = {"user": 12, "source_ip": 10, "auth_method": 1}
SEGMENTS = 4
_STREAMS: dict[tuple, AuthLogStream] = {}


def _table(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inputs:
    """Derived inputs and the tables computed from them, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def table(self):
        return _table(self.spark, self.sf_dir)

    def _stream(self, start) -> int:
        """Runs a stream over the whole table until it is used up; number of its last batch."""
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        # the files of a table arrive together and in no order, so they are one micro-batch;
        # several batches are for segments, which arrive one after the other
        # (a pattern, as a stream takes a single file by pattern only)
        query = start(self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/events.parque[t]"))
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        return query.lastProgress["batchId"]

    def _folder(self) -> str:
        return f"{checkpoint_folder(self.spark)}/stream-{uuid.uuid4().hex}"

    @cached_property
    def log_stream(self) -> AuthLogStream:
        return self._log_stream(None)

    @cached_property
    def bounded_stream(self) -> AuthLogStream:
        """With the shortest age: an accept serves its own segment only."""
        return self._log_stream("1 MILLISECOND")

    def _log_stream(self, max_age: str | None) -> AuthLogStream:
        """The lines as ordered segments, taken in by one run after the other of the same stream.

        Several registered queries read the tables of one stream, so a session makes it once for a folder.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, max_age)
        if key not in _STREAMS:
            folder = self._folder()
            stream, landing = AuthLogStream(self.spark, folder, AS_OF, max_age=max_age), f"{folder}/landing"
            first, last = self.table.agg(F.min("event_id"), F.max("event_id")).first()

            def segment(seq: str) -> str:
                return f"({seq} div 2 - {first or 0}) * {SEGMENTS} div {(last or 0) - (first or 0) + 1}"

            for n in range(SEGMENTS):
                # the events of a segment are picked and dealt out before lines are made of them
                own = self.table.filter(f"{n} IN ({segment('(2 * event_id)')}, {segment('(2 * event_id + 1)')})")
                lines = derived.log_lines(own.repartition("event_id")).filter(f"{segment('seq')} = {n}")
                lines.write.mode("append").parquet(landing)
                stream.run(self.spark.readStream.schema(self.lines.schema).parquet(landing))
            _STREAMS[key] = stream
        return _STREAMS[key]

    @cached_property
    def snapshot_stream(self) -> tuple[SnapshotStream, int]:
        stream = SnapshotStream(self.spark, self._folder(), known_users=self.users)
        return stream, self._stream(lambda table: stream.start(derived.who_lines(table)))

    @cached_property
    def rotated(self) -> str:
        folder = f"{checkpoint_folder(self.spark)}/rotated-{uuid.uuid4().hex}"
        rotated.write_rotated(self.lines, folder)
        return folder

    @cached_property
    def lines(self):
        return derived.log_lines(self.table)

    @cached_property
    def events(self):
        return parse_auth_events(self.lines, AS_OF)

    def parse_once(self) -> None:
        """Stores the events, for queries whose plan reads them more than once."""
        folder = f"{checkpoint_folder(self.spark)}/events-{uuid.uuid4().hex}"
        self.events.drop("line").write.parquet(folder)
        self.events = self.spark.read.schema(self.events.drop("line").schema).parquet(folder)

    @cached_property
    def sessions(self):
        return correlation.sessions(self.events, AS_OF)

    @cached_property
    def failed(self):
        return failures.failed_attempts(self.events)

    @cached_property
    def snapshots(self):
        return derived.who_lines(self.table)

    @cached_property
    def active(self):
        return who.active_sessions(self.snapshots)

    @cached_property
    def ptr(self):
        return derived.ptr_rows(self.table)

    @cached_property
    def users(self):
        return metrics.unique_users(self.events)

    @cached_property
    def registry(self):
        return labels.label_registry(self.events, AS_OF).stored()

    @cached_property
    def snapshot_registry(self):
        return labels.extend_registry(
            self.registry, labels.snapshot_sightings(self.active, self.users)
        ).stored()


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def _query(name: str):
    def add(build):
        _QUERIES[name] = build
        return build

    return add


def _add(**builders) -> None:
    _QUERIES.update(builders)


def _ts_inference(i: Inputs) -> DataFrame:
    """The same lines read as of the end and as of the middle of their month."""
    late = parse_auth_events(i.lines, AS_OF).select("seq", F.col("ts").alias("ts_end"))
    early = parse_auth_events(i.lines, "2024-01-15").select("seq", F.col("ts").alias("ts_mid"))
    return late.join(early, "seq")


def _source_details(i: Inputs) -> DataFrame:
    rows = add_source_details(who.parse_who(i.snapshots), "source")
    return rows.select(
        "snapshot_id", "line_no", F.col("source").alias("raw"), F.col("source_display").alias("source"),
        "source_ip", "source_hostname", "source_display",
    )


def _report(i: Inputs, folder: str) -> DataFrame:
    """Report of the files of a folder by name; how many lines a damaged file still gives is left out."""
    lines, files = logs.read_logs(i.spark, folder, recursive=True), logs.list_logs(i.spark, folder, recursive=True)
    by_name = logs.ingest_report(lines, is_recognised("value"), files).groupBy("file_name").agg(
        F.sum("lines").alias("lines"), F.sum("auth_lines").alias("auth_lines"), F.min("status").alias("status")
    )
    sound = F.col("status") == "ok"
    return by_name.select("file_name", *[F.when(sound, F.col(c)).alias(c) for c in ("lines", "auth_lines")], "status")


def _ingest_damage(i: Inputs) -> DataFrame:
    folder = f"{checkpoint_folder(i.spark)}/damaged-{uuid.uuid4().hex}"
    rotated.write_damaged(i.lines, folder)
    return _report(i, folder)


_add(
    ingest_files=lambda i: _report(i, i.rotated),
    ingest_damage=_ingest_damage,
    scan_rotated=lambda i: logs.read_logs(i.spark, i.rotated, recursive=True)
    .filter(F.col("file_name") != rotated.DAMAGED)
    .select("file_name", "value"),
    ingest_report=lambda i: logs.ingest_report(i.lines, is_recognised("value")),
    parse_events=lambda i: i.events,
    event_kind_counts=lambda i: i.events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    ev_accepted=lambda i: events_of(i.events, "accepted"),
    ev_opened=lambda i: events_of(i.events, "session_opened"),
    ev_closed=lambda i: events_of(i.events, "session_closed"),
    ev_invalid_user=lambda i: events_of(i.events, "invalid_user"),
    ev_failed_password=lambda i: events_of(i.events, "failed_password"),
    ev_preauth=lambda i: events_of(i.events, "preauth_closed"),
    ev_port_forward=lambda i: events_of(i.events, "port_forward_error"),
    ev_max_auth=lambda i: events_of(i.events, "max_auth"),
    ts_inference=_ts_inference,
    who_parse=lambda i: who.parse_who(i.snapshots),
    who_remote=lambda i: who.parse_who(i.snapshots).filter(is_remote("source")),
    source_details=_source_details,
)

_add(
    session_opens=lambda i: correlation.session_opens(i.events),
    sessions=lambda i: i.sessions,
    session_durations=lambda i: i.sessions.select("close_seq", "user", "duration_seconds"),
    open_sessions=lambda i: correlation.open_sessions(i.events),
    invalid_dedup=lambda i: failures.invalid_users(i.events).select("seq", "host", "pid", "user", "source_ip", "ts"),
    invalid_port_backfill=lambda i: failures.invalid_users(i.events)
    .filter((F.col("port") == "") & (F.col("full_port") != ""))
    .select("seq", "pid", F.col("full_port").alias("port")),
    failed_attempts=lambda i: i.failed,
)

_add(
    m_failed_raw=lambda i: metrics.failed_logins(i.failed),
    m_logins=lambda i: metrics.logins(i.events, i.registry),
    m_logins_full=lambda i: metrics.logins(i.events),
    m_logouts=lambda i: metrics.logouts(i.events, i.registry),
    m_failed=lambda i: metrics.failed_logins(i.failed, i.registry),
    m_failed_bounded=lambda i: metrics.failed_logins(
        i.failed, labels.label_registry(i.events, AS_OF, SMALL_CAPS).stored()
    ),
    m_invalid=lambda i: metrics.invalid_user_attempts(i.failed, i.registry),
    m_active=lambda i: metrics.active_session_gauge(i.active, i.snapshots, i.snapshot_registry),
    m_unique_users=lambda i: metrics.unique_user_count(i.events),
    m_duration_hist=lambda i: metrics.duration_histogram(i.sessions, i.registry),
    m_errors=lambda i: metrics.errors(i.events),
    m_preauth=lambda i: metrics.preauth_closes(i.events, i.registry),
    m_heatmap=lambda i: metrics.login_heatmap(i.events),
    m_user_online=lambda i: metrics.user_online(i.users, i.active, i.snapshots, i.snapshot_registry),
    q_active_total=lambda i: metrics.active_total(
        metrics.active_session_gauge(i.active, i.snapshots, i.snapshot_registry)
    ),
    q_failed_1h=lambda i: metrics.failed_per_hour(i.failed),
    q_failed_1h_sliding=lambda i: metrics.failed_per_hour(i.failed, slide="15 minutes"),
    q_avg_duration_1h=lambda i: metrics.average_duration(i.sessions),
    label_registry=lambda i: labels.label_registry(i.events, AS_OF, SMALL_CAPS).rows,
    label_display=lambda i: labels.label_registry(
        enrich.enrich_hosts_ttl(i.events, i.ptr), AS_OF
    ).rows.filter(F.col("dimension") == "source_ip").select("value", "display"),
)

_add(
    r_active=lambda i: reports.current_sessions(i.active, i.snapshots),
    r_history=lambda i: reports.session_history(i.sessions),
    r_failed=lambda i: reports.failed_history(i.failed),
    history_range=lambda i: reports.session_history(i.sessions, 150, START, END),
    failed_range=lambda i: reports.failed_history(i.failed, 300, START, END),
    history_json=lambda i: reports.session_json(reports.session_history(i.sessions)),
    failed_json=lambda i: reports.failed_json(reports.failed_history(i.failed)),
    r_history_trimmed=lambda i: reports.session_history(i.sessions, 500, START, END, max_history=600),
    r_summary=lambda i: reports.summary(i.sessions, i.failed, i.users),
    r_logins_per_user=lambda i: reports.logins_per_user(i.sessions),
    r_top_ips=lambda i: reports.top_values(i.sessions, "source_ip"),
    r_top_sources=lambda i: reports.top_sources(i.sessions, i.ptr),
    r_unique_users=lambda i: reports.unique_user_names(i.users),
    r_heatmap=lambda i: reports.heatmap(i.events),
    r_heatmap_range=lambda i: reports.heatmap(i.events, START, END),
    r_users_status=lambda i: reports.users_status(i.users, i.active, i.snapshots),
    enrich_hosts=lambda i: enrich.enrich_hosts(i.failed, i.ptr),
    enrich_hosts_ttl=lambda i: enrich.enrich_hosts_ttl(
        events_of(i.events, "preauth_closed"), i.ptr
    ),
)


@_query("m_logins_full_pinned")
def _logins_pinned(i: Inputs) -> DataFrame:
    """Unbounded labels; a source whose name changes keeps the one seen first."""
    events = enrich.enrich_hosts_ttl(i.events, i.ptr)
    return metrics.logins(events, displays=labels.pinned_displays(events, AS_OF))


def _stream_active(i: Inputs) -> DataFrame:
    stream, last = i.snapshot_stream
    return stream.active.after(last)


def _stream_online(i: Inputs) -> DataFrame:
    stream, last = i.snapshot_stream
    return stream.online.after(last)


_add(
    stream_events=lambda i: i.log_stream.events.read().select("seq", "host", "pid", "kind", "user", "source_ip", "port", "ts"),
    stream_sessions=lambda i: i.log_stream.sessions.drop("close_user"),
    stream_failed=lambda i: i.log_stream.all_attempts(),
    stream_counters=lambda i: i.log_stream.counts(),
    stream_registry=lambda i: i.log_stream.label_registry().rows,
    stream_histogram=lambda i: i.log_stream.histogram(),
    stream_heatmap=lambda i: i.log_stream.heatmap(),
    stream_unique_users=lambda i: i.log_stream.unique_users(),
    stream_samples=lambda i: _labels_as_text(i.log_stream.samples.read_batches([i.log_stream.last_batch()])),
    stream_bounded=lambda i: i.bounded_stream.sessions.drop("close_user"),
    stream_active=_stream_active,
    stream_online=_stream_online,
)


def _labels_as_text(samples: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    text = F.array_join(F.array_sort(pairs), ",").alias("labels")
    return samples.select("metric", "type", text, "value", *[c for c in samples.columns if c == "sample_time"])


@_query("metric_samples")
def _metric_samples(i: Inputs) -> DataFrame:
    """All families; the label map is written as text, as maps do not compare."""
    samples = metrics.metric_samples(
        i.events, i.sessions, i.failed, i.registry, i.snapshots, i.active, i.snapshot_registry
    )
    return _labels_as_text(samples)


# queries with several branches over the events; the others parse within their only branch
_SEVERAL = {
    "invalid_dedup", "invalid_port_backfill", "failed_attempts", "m_failed_raw", "m_logins", "m_logouts", "m_failed",
    "m_failed_bounded", "m_invalid", "m_active", "m_duration_hist", "m_preauth", "m_user_online", "q_active_total",
    "q_failed_1h", "q_failed_1h_sliding", "label_registry", "label_display", "m_logins_full_pinned", "r_failed",
    "failed_range", "failed_json", "r_summary", "enrich_hosts", "metric_samples",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(name, build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            inputs = Inputs(spark, sf_dir)
            if name in _SEVERAL:
                inputs.parse_once()
            return build(inputs)

        return query

    return {name: run(name, build) for name, build in _QUERIES.items()}
