"""Micro-batches of log segments through the same jobs a whole log goes through.

Two queries, joined by a table.  ``ingest`` parses a micro-batch and settles with windows all that its
chunks tell by themselves.  ``correlate`` follows it: the few rows at the edges of chunks meet what
their process id has in the state store (``keyed.Correlator``), and registry and counters grow by the
batches that came.  Results equal those of one run over everything.  Segments are immutable files moved
into the landing folder; each is read exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import labels, metrics
from ..operators.chunks import KEY
from ..operators.failures import attempts_of, counted_invalid_users, other_failures, report_chunks
from ..operators.labels import LabelRegistry
from ..operators.parse import parse_auth_events
from ..operators.sessions import CLOSED, DONE, OPENED, in_chunks, session_rows
from ..operators.storage import move_in, names_in
from ..schemas import LABEL_CAPS, auth_events
from . import keyed
from .registry import SharedRegistry
from .state import BatchTable, CarriedState

_COUNTER_LABELS = ["user", "source_ip", "source_display", "auth_method", "error_type"]
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_segments(
    spark: SparkSession, landing: str, pattern: str = "*", max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Stream of lines with the file facts that give their arrival order."""
    reader = spark.readStream.option("pathGlobFilter", pattern).option("latestFirst", False)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    meta = F.col("_metadata")
    return reader.text(landing).select(
        "value",
        meta.file_name.alias("file_name"),
        meta.file_modification_time.alias("file_time"),
        meta.file_block_start.alias("block_start"),
    )


def segment_seq(batch_id: int) -> Column:
    """Arrival order over all batches: batch, age of the segment, place inside it."""
    return F.struct(
        F.lit(batch_id).cast("bigint").alias("batch"),
        F.unix_micros("file_time").alias("file_time"),
        F.col("file_name").alias("file_name"),
        F.col("block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def milliseconds(interval: str | None) -> int | None:
    """An interval such as "30 MINUTES" in milliseconds."""
    if interval is None:
        return None
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {interval})")).first()[0]


@dataclass
class AuthLogStream:
    """Continuous events, sessions, failed attempts, counters and label registry.

    ``as_of`` fixes the clock; by default a segment's own date settles its years.
    ``max_age`` (an interval, of processing time) bounds what a process id may leave behind: an accept not
    used by then is forgotten, a report held back for its repetition is written as it is.
    """

    spark: SparkSession
    base: str
    as_of: object = None
    caps: dict = field(default_factory=lambda: dict(LABEL_CAPS))
    max_age: str | None = None
    registry: SharedRegistry | None = None

    def __post_init__(self):
        if self.registry is None:
            self.registry = SharedRegistry(self.spark, f"{self.base}/registry", self.caps)

        def table(name):
            return BatchTable(self.spark, f"{self.base}/{name}")

        def state(name):
            return CarriedState(self.spark, f"{self.base}/state/{name}")

        # of ingest, by its batches: rows settled inside their chunks, and runs whose start is not known
        self.events, self.inner_sessions, self.inner_failed, self.leading = (
            table(n) for n in ("events", "sessions", "failed_attempts", "leading_runs")
        )
        self.edges = f"{self.base}/edges"
        # of correlate, by its batches
        self.settled, self.edge_sessions, self.edge_failed = (
            table(n) for n in ("settled", "edge_sessions", "edge_failed_attempts")
        )
        self.counters, self.durations, self.hours, self.totals = (
            state(n) for n in ("counters", "durations", "hours", "totals")
        )
        self.new_users, self.samples = table("new_users"), table("samples")
        # results of the window jobs, which several outputs of a batch are made from
        self.chunks, self.reports = state("chunks"), state("reports")

    @property
    def clock(self):
        return self.as_of or datetime.now()

    def start(self, lines: DataFrame, trigger: dict) -> tuple[StreamingQuery, StreamingQuery]:
        """Both queries, side by side, with a trigger such as ``{"processingTime": "10 seconds"}``."""
        return self.ingest(lines, trigger), self.correlate(lines, trigger)

    def run(self, lines: DataFrame) -> None:
        """Takes in all there is, then stops."""
        # a query with timers always finds another batch to run, so it is told to run one
        once = {"availableNow": True} if self.max_age is None else {"once": True}
        for start, trigger in ((self.ingest, {"availableNow": True}), (self.correlate, once)):
            query = start(lines, trigger)
            query.awaitTermination()
            if query.exception() is not None:
                raise query.exception()

    def ingest(self, lines: DataFrame, trigger: dict) -> StreamingQuery:
        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.base}/checkpoint")
        return writer.trigger(**trigger).start()

    def correlate(self, lines: DataFrame, trigger: dict) -> StreamingQuery:
        """Follows the edges that ``ingest`` leaves; ``lines`` only tells what their order looks like."""
        seq = lines.schema["seq"].dataType if "seq" in lines.columns else _segment_order(self.spark)
        schema = self._edges(self._chunks(_no_events(self.spark, seq)), self._reports(_no_events(self.spark, seq)), 0).schema
        names_in(self.spark, self.edges, create=True)
        edges = self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(self.edges)
        before = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
        try:
            writer = keyed.correlated(edges, milliseconds(self.max_age)).writeStream.outputMode("append")
            writer = writer.foreachBatch(self.settle).option("checkpointLocation", f"{self.base}/checkpoint-keys")
            return writer.trigger(**trigger).start()
        finally:
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

    @staticmethod
    def _chunks(events: DataFrame) -> DataFrame:
        return in_chunks(events).drop("wanted")

    @staticmethod
    def _reports(events: DataFrame) -> DataFrame:
        return report_chunks(events)

    @staticmethod
    def _edges(chunks: DataFrame, reports: DataFrame, batch_id: int) -> DataFrame:
        parts = keyed.login_edges(chunks, batch_id), keyed.report_edges(reports, batch_id)
        mark = keyed.batch_mark(chunks.sparkSession, batch_id)
        return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(mark, allowMissingColumns=True)

    def process(self, lines: DataFrame, batch_id: int) -> None:
        """One micro-batch of ``ingest``: its events, what its chunks settle, and their edges."""
        if "seq" not in lines.columns:
            lines = lines.withColumn("seq", segment_seq(batch_id))
        # a file may be one task's to read (gzip, one row group), but not its lines to parse
        lines = lines.repartition("seq")
        clock = self.as_of if self.as_of is not None else F.col("file_time")
        events = self.events.write(parse_auth_events(lines, clock), batch_id)

        self.chunks.write(self._chunks(events), batch_id)
        chunks = self.chunks.after(batch_id)
        self.inner_sessions.write(session_rows(chunks.filter(DONE), self.clock), batch_id)

        self.reports.write(self._reports(events), batch_id)
        reports = self.reports.after(batch_id)
        inside = reports.filter("next IS NOT NULL")
        own = inside.filter("run_start IS NOT NULL").withColumn("run_pos", F.expr("pos - run_start + 1"))
        attempts = attempts_of(counted_invalid_users(own)).unionByName(other_failures(events))
        self.inner_failed.write(attempts, batch_id)
        self.leading.write(inside.filter("run_start IS NULL").drop("run_start", "head"), batch_id)

        # the edges appear at once, and only once
        name = f"{batch_id:010d}"
        if name not in names_in(self.spark, self.edges, create=True):
            staged = f"{self.base}/staged-edges"
            self._edges(chunks, reports, batch_id).write.mode("overwrite").parquet(staged)
            move_in(self.spark, staged, f"{self.edges}/{name}")

    def settle(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch of ``correlate``: what the state settles, then registry and counters."""
        out = self.settled.write(rows, batch_id)
        batches = sorted(r.batch for r in out.filter(F.col("part") == keyed.BATCH).select("batch").collect())
        held, reports = (self._reports_of(out.filter(F.col("part") == p), batches) for p in (keyed.HELD, keyed.REPORT))
        written = attempts_of(counted_invalid_users(reports)) if reports is not None else None
        sessions = self._sessions_of(out.filter(F.col("part") == keyed.SESSION), batches)
        if not batches:  # only timers went off
            if written is not None:
                self.edge_failed.write(written, batch_id)
            for state in (self.counters, self.durations, self.hours, self.totals):
                state.write(state.after(batch_id - 1), batch_id)
            return
        finished = self.edge_sessions.write(sessions, batch_id).unionByName(self.inner_sessions.read_batches(batches))
        leading = attempts_of(counted_invalid_users(self._leading(out, batches)))
        self.edge_failed.write(written.unionByName(leading), batch_id)
        # a held report counts at once
        counted = attempts_of(counted_invalid_users(held)).unionByName(leading)
        counted = counted.unionByName(self.inner_failed.read_batches(batches))
        events = self.events.read_batches(batches)
        self._registry(events, finished, batch_id)
        self._counters(events, counted, batch_id)
        self._gauges(events, finished, batch_id)
        self._samples(events, batch_id)

    def _leading(self, out: DataFrame, batches: list[int]) -> DataFrame:
        """Reports of the runs that chunks begin with; a carried report comes before them."""
        rows = self.leading.read_batches(batches, keep=True)
        chunk = rows.schema["chunk"].dataType.simpleString()
        carried = out.filter(F.col("part") == keyed.CARRY).select(
            *KEY,
            F.col("batch").alias("batch_id"),
            F.from_json("chunk", f"chunk {chunk}")["chunk"].alias("chunk"),
            F.lit(1).alias("carry"),
        )
        return rows.join(carried, [*KEY, "batch_id", "chunk"], "left").withColumn(
            "run_pos", F.expr("pos + coalesce(carry, 0)")
        )

    def _reports_of(self, out: DataFrame, batches: list[int]) -> DataFrame | None:
        """Rows of the state as counted reports: ``row``, and ``next`` if one came."""
        known = self._report_types()
        if known is None:
            return None
        row, seq = known
        return out.select(
            *KEY,
            F.from_json("body", f"row {row}, seq {seq}", keyed.JSON).alias("b"),
            F.from_json("next", row, keyed.JSON).alias("next"),
        ).select(*KEY, "b.seq", "b.row", F.lit(1).alias("run_pos"), "next")

    def _report_types(self) -> tuple[str, str] | None:
        names = names_in(self.spark, self.leading.path)
        if not names:
            return None
        schema = self.spark.read.parquet(f"{self.leading.path}/{names[0]}").schema
        return schema["row"].dataType.simpleString(), schema["seq"].dataType.simpleString()

    def _open_of(self, rows: DataFrame) -> DataFrame:
        """``rows`` (body, login) of opens as the column ``open``, as ``sessions.correlate`` gives it."""
        events = self.events.read()
        login = ", ".join(f"{c} string" for c in ("source_ip", "source_hostname", "source_display", "auth_method", "port") if c in events.columns)
        body = f"user string, ts timestamp_ntz, seq {events.schema['seq'].dataType.simpleString()}"
        rows = rows.withColumns(
            {"_o": F.from_json("opened", body, keyed.JSON), "_l": F.from_json("login", login, keyed.JSON)}
        )
        return rows.withColumn(
            "open",
            F.struct(F.lit(OPENED).alias("kind"), "_o.user", F.col("_l").alias("login"), "_o.ts", "_o.seq"),
        ).drop("_o", "_l")

    def _sessions_of(self, out: DataFrame, batches: list[int]) -> DataFrame:
        seq = self.events.read().schema["seq"].dataType.simpleString()
        rows = out.withColumn("_c", F.from_json("body", f"user string, ts timestamp_ntz, seq {seq}", keyed.JSON))
        rows = self._open_of(rows).withColumn("kind", F.lit(CLOSED)).select(*KEY, "kind", "open", "_c.*")
        return session_rows(rows, self.clock)

    @property
    def sessions(self) -> DataFrame:
        """All finished sessions so far."""
        return self.inner_sessions.read().unionByName(self.edge_sessions.read())

    def state(self, name: str) -> DataFrame:
        """What is in the state store: ``accept``, ``open`` or ``held``, one row per process id."""
        rows = (
            self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.base}/checkpoint-keys")
        )
        return rows.select("key.*", "value.*")

    def open_sessions(self) -> DataFrame:
        """Sessions without a close so far: host, pid, user, login_time."""
        rows = self._open_of(self.state("open").withColumnRenamed("body", "opened"))
        return rows.select(*KEY, F.col("open.user").alias("user"), F.col("open.ts").alias("login_time"))

    def held_attempts(self) -> DataFrame:
        """Attempts still waiting for a repetition, as they stand."""
        rows = self.state("held").select(*KEY, "body", F.lit(None).cast("string").alias("next"))
        return attempts_of(counted_invalid_users(self._reports_of(rows, [])))

    def failed_attempts(self) -> DataFrame:
        """Failed attempts written so far."""
        return self.inner_failed.read().unionByName(self.edge_failed.read())

    def all_attempts(self) -> DataFrame:
        """Failed attempts so far, with those still held back."""
        return self.failed_attempts().unionByName(self.held_attempts())

    def last_batch(self) -> int:
        """Number of the last finished micro-batch of ``correlate``."""
        return max(int(n) for n in names_in(self.spark, f"{self.base}/checkpoint-keys/commits") if n.isdigit())

    def _registry(self, events: DataFrame, finished: DataFrame, batch_id: int) -> None:
        self.registry.extend("log", batch_id, labels.log_sightings(events, self.clock, finished))

    def label_registry(self, batch_id: int | None = None) -> LabelRegistry:
        """The registry as a batch left it, by default the newest."""
        return self.registry.latest() if batch_id is None else self.registry.of("log", batch_id)

    def counts(self) -> DataFrame:
        """The counters so far: metric, labels, value."""
        return self.counters.after(self.last_batch())

    def _counters(self, events: DataFrame, failed: DataFrame, batch_id: int) -> None:
        """Adds the batches' counts to the counters so far, under the labels known by now."""
        names = self.label_registry(batch_id)
        counts = metrics.event_counters(events, names)
        for metric, rows in (
            ("ssh_failed_logins_total", metrics.failed_logins(failed, names)),
            ("ssh_invalid_user_attempts_total", metrics.invalid_user_attempts(failed, names)),
        ):
            counts = counts.unionByName(rows.withColumn("metric", F.lit(metric)), allowMissingColumns=True)
        before = self.counters.before(batch_id)
        if before is not None:
            counts = counts.unionByName(before)
        total = counts.groupBy("metric", *_COUNTER_LABELS).agg(F.sum("value").alias("value"))
        self.counters.write(total, batch_id)


    @staticmethod
    def _added(state: CarriedState, rows: DataFrame, batch_id: int, value: str) -> None:
        """Adds a batch's rows to sums kept per their other columns."""
        before = state.before(batch_id)
        both = rows if before is None else rows.unionByName(before)
        state.write(both.groupBy(*[c for c in rows.columns if c != value]).agg(F.sum(value).alias(value)), batch_id)

    def _gauges(self, events: DataFrame, finished: DataFrame, batch_id: int) -> None:
        """Sums that only grow: duration buckets, login hours, and the number of users.

        The users themselves stay where they came first; a batch looks its own up and adds the new ones.
        """
        names = self.label_registry(batch_id)
        self._added(self.durations, metrics.duration_histogram(finished, names), batch_id, "value")
        self._added(self.hours, metrics.logins_by_hour(events), batch_id, "n")
        users = metrics.unique_users(events)
        there = set(names_in(self.spark, self.new_users.path))
        earlier = [n for n in range(batch_id) if f"batch_id={n}" in there]
        if earlier:
            users = users.join(self.new_users.read_batches(earlier), "user", "left_anti")
        fresh = self.new_users.write(users, batch_id)
        count = fresh.agg(F.count(F.lit(1)).alias("value")).withColumn("name", F.lit("users"))
        self._added(self.totals, count, batch_id, "value")

    def histogram(self, batch_id: int | None = None) -> DataFrame:
        """(user, series, le, value): buckets, sum and count of durations so far."""
        return self.durations.after(self.last_batch() if batch_id is None else batch_id)

    def heatmap(self, batch_id: int | None = None) -> DataFrame:
        return metrics.heatmap_of(self.hours.after(self.last_batch() if batch_id is None else batch_id))

    def unique_users(self, batch_id: int | None = None) -> DataFrame:
        return self.totals.after(self.last_batch() if batch_id is None else batch_id).select("value")

    def _samples(self, events: DataFrame, batch_id: int) -> None:
        """All families as they stand after the batch, with its newest event's time as sample time.

        They are the batch's own part of the table, which a repeated batch replaces.
        """
        rows = metrics.counter_samples(self.counters.after(batch_id))
        for frame in metrics.gauge_samples(self.histogram(batch_id), self.unique_users(batch_id), self.heatmap(batch_id)):
            rows = rows.unionByName(frame)
        newest = events.agg(F.max("ts").alias("t")).scalar()
        self.samples.write(rows.withColumn("sample_time", newest), batch_id)


def _no_events(spark: SparkSession, seq) -> DataFrame:
    return spark.createDataFrame([], auth_events(seq))


def _segment_order(spark: SparkSession):
    """The type of ``segment_seq``."""
    empty = spark.createDataFrame([], "file_time timestamp, file_name string, block_start bigint")
    return empty.select(segment_seq(0).alias("seq")).schema["seq"].dataType
