"""What a process id carries from one chunk of its log to the next, in Spark's state store.

Windows settle nearly everything inside a chunk (``sessions.in_chunks``,
``failures.report_chunks``); only rows at the edges of chunks come here, a few per chunk and
process id, however many rows the chunk has.  A key's state is its unused accept, its open session and
its unpaired report, and a micro-batch touches the keys it has rows of and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.chunks import KEY
from ..operators.sessions import ACCEPTED, AT_EDGE, CLOSED, OPENED

LOGIN, REPORT, BATCH = "login", "report", "batch"
SESSION, CARRY, HELD = "session", "carry", "held"

# JSON keeps what the state only passes on, so that its schema does not depend on the events' columns
JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
PAYLOAD = ("body", "login", "opened", "chunk", "head", "user", "source_ip", "head_user", "head_ip")
RESULT = "part string, host string, pid string, batch bigint, chunk string, body string, opened string, login string, next string"


def as_json(*columns: str) -> F.Column:
    return F.to_json(F.struct(*[F.expr(c) for c in columns]), JSON)


def login_edges(rows: DataFrame, batch_id: int) -> DataFrame:
    """Edge rows of ``sessions.in_chunks``."""
    known = F.col("open.kind") == OPENED
    return rows.filter(AT_EDGE).select(
        F.lit(LOGIN).alias("part"),
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEY],
        F.lit(batch_id).cast("bigint").alias("batch"),
        "seq",
        "kind",
        "settled",
        as_json("user", "ts", "seq").alias("body"),
        F.to_json(F.when(F.col("kind") == CLOSED, F.col("open.login")).otherwise(F.col("auth.login")), JSON).alias("login"),
        F.when(known, as_json("open.user AS user", "open.ts AS ts", "open.seq AS seq")).alias("opened"),
    )


def report_edges(rows: DataFrame, batch_id: int) -> DataFrame:
    """The last report of each chunk of ``failures.report_chunks``, with the first one and the run it ends."""
    return rows.filter("next IS NULL").select(
        F.lit(REPORT).alias("part"),
        *KEY,
        F.lit(batch_id).cast("bigint").alias("batch"),
        "seq",
        as_json("chunk").alias("chunk"),
        F.col("run_start").isNull().alias("settled"),
        ((F.col("pos") - F.coalesce("run_start", F.lit(1)) + 1) % 2 == 1).alias("odd"),
        as_json("row", "seq").alias("body"),
        F.to_json("head", JSON).alias("head"),
        *[F.col(f"row.{c}").alias(c) for c in ("user", "source_ip")],
        *[F.col(f"head.{c}").alias(f"head_{c.removeprefix('source_')}") for c in ("user", "source_ip")],
    )


def batch_mark(spark, batch_id: int) -> DataFrame:
    """One row that tells which micro-batch the edges are of, even if there are none."""
    return spark.range(1).select(
        F.lit(BATCH).alias("part"), F.lit("").alias("host"), F.lit("").alias("pid"), F.lit(batch_id).cast("bigint").alias("batch")
    )


def _arrival(row: Row) -> tuple:
    """Sort key of a row; a compound order comes as a dictionary."""
    return tuple(row.seq.values()) if isinstance(row.seq, dict) else (row.seq,)


class Correlator(StatefulProcessor):
    """Settles the edge rows of one (host, pid) in arrival order.

    ``max_age`` (milliseconds) bounds how long an unused accept and an unpaired report are kept, in
    processing time: the accept is forgotten, the report goes out as it stands.  Open sessions stay.
    """

    def __init__(self, max_age: int | None = None):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        def text(*names: str) -> StructType:
            return StructType([StructField(n, StringType()) for n in names])

        self.handle = handle
        self.accept = handle.getValueState("accept", text("login"), self.max_age)
        self.open = handle.getValueState("open", text("body", "login"))
        self.held = handle.getValueState("held", text("user", "source_ip", "body", "until"))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        parts: dict[str, list[Row]] = {}
        for row in rows:
            parts.setdefault(row.part, []).append(row)
        for row in parts.get(BATCH, ()):
            yield self._out(BATCH, key, batch=row.batch)
        if LOGIN in parts:
            yield from self._logins(key, sorted(parts[LOGIN], key=_arrival))
        if REPORT in parts:
            yield from self._reports(key, sorted(parts[REPORT], key=_arrival), timerValues)

    @staticmethod
    def _out(part: str, key, **values) -> Row:
        names = ("batch", "chunk", "body", "opened", "login", "next")
        return Row(part=part, host=key[0], pid=key[1], **{n: values.get(n) for n in names})

    def _logins(self, key, rows: list[Row]) -> Iterator[Row]:
        accept, opened = self.accept.get(), self.open.get()
        accept, before = accept and accept[0], (accept, opened)
        for row in rows:
            if row.kind == ACCEPTED:
                accept = row.login
            elif row.kind == OPENED:
                opened, accept = (row.body, row.login if row.settled else accept), None
            else:
                found, opened = ((row.opened, row.login) if row.settled else opened), None
                if found and found[0]:
                    yield self._out(SESSION, key, batch=row.batch, body=row.body, opened=found[0], login=found[1])
        for state, old, new in ((self.accept, before[0], accept and (accept,)), (self.open, before[1], opened)):
            if new:
                if old is None or tuple(old) != tuple(new):
                    state.update(tuple(new))
            elif old is not None:
                state.clear()

    def _reports(self, key, rows: list[Row], timers) -> Iterator[Row]:
        held = self.held.get()
        was_held = held is not None
        for row in rows:
            same = held is not None and (held[0], held[1]) == (row.head_user, row.head_ip)
            if same:
                yield self._out(CARRY, key, batch=row.batch, chunk=row.chunk)
            if held is not None:
                yield self._out(REPORT, key, body=held[2], next=row.head)
            held = None
            # a chunk that is one run goes on where the run before it ended
            if row.odd != (same and row.settled):
                held = (row.user, row.source_ip, row.body, None)
                yield self._out(HELD, key, batch=row.batch, body=row.body)
        if held is None:
            if was_held:
                self.held.clear()
            return
        if self.max_age is not None:
            until = timers.getCurrentProcessingTimeInMs() + self.max_age
            held = (*held[:3], str(until))
            self.handle.registerTimer(until)
        self.held.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        # a later report has a timer of its own
        if held is not None and int(held[3]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self._out(REPORT, key, body=held[2])

    def close(self) -> None:
        pass


def correlated(edges: DataFrame, max_age: int | None) -> DataFrame:
    """Stream of what the edge rows settle: sessions, carried runs and reports."""
    return edges.groupBy(*KEY).transformWithState(
        Correlator(max_age), RESULT, "append", "None" if max_age is None else "ProcessingTime"
    )
