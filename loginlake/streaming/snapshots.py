"""Gauges over arriving login snapshots; label sets once seen stay, at 0 when gone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import labels
from ..operators.labels import LabelRegistry, apply_labels
from ..operators.metrics import latest_snapshot
from ..sources.who import active_sessions
from .registry import SharedRegistry
from .state import BatchTable, CarriedState

_SETS = "user string, source_ip string, source_display string, value bigint"


def read_snapshot_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Stream of snapshot lines; a file is a snapshot and file names sort in time order."""
    reader = spark.readStream.option("latestFirst", False)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(landing).select(F.col("_metadata.file_name").alias("snapshot_id"), "value")


@dataclass
class SnapshotStream:
    """Keeps the active-session and user-online gauges after each micro-batch.

    ``registry`` is the label registry of the log, whose caps hold throughout: one as it stands, or the
    one that a log stream goes on extending.  ``known_users`` (user) the users it has seen: a table, or a function that gives the
    present one for each micro-batch.
    """

    spark: SparkSession
    base: str
    registry: LabelRegistry | SharedRegistry | None = None
    known_users: DataFrame | Callable[[], DataFrame] | None = None

    def __post_init__(self):
        self.sessions = BatchTable(self.spark, f"{self.base}/active_sessions")
        self.active, self.online, self.names = (
            CarriedState(self.spark, f"{self.base}/state/{n}") for n in ("active", "online", "registry")
        )

    def start(self, lines: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        writer = lines.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", f"{self.base}/checkpoint"
        )
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def process(self, lines: DataFrame, batch_id: int) -> None:
        numbered = lines
        if "line_no" not in lines.columns:
            numbered = lines.withColumn("line_no", F.monotonically_increasing_id())
        active = self.sessions.write(active_sessions(numbered), batch_id)
        users = self.known_users() if callable(self.known_users) else self.known_users
        names = self._names(active, users, batch_id)
        here = F.col("snapshot_id") == latest_snapshot(lines)

        label_sets = ["user", "source_ip", "source_display"]
        shown = apply_labels(active.select(*label_sets, here.alias("here")), names)
        now = shown.groupBy(*label_sets).agg(F.count_if("here").alias("value"))
        gone = self.active.before(batch_id, _SETS).withColumn("value", F.lit(0).cast("bigint"))
        self.active.write(
            now.unionByName(gone).groupBy(*label_sets).agg(F.sum("value").alias("value")), batch_id
        )

        online = shown.groupBy("user").agg(F.max(F.col("here").cast("bigint")).alias("value"))
        offline = self.online.before(batch_id, "user string, value bigint").select("user")
        if users is not None:
            offline = offline.unionByName(apply_labels(users.select("user"), names))
        online = online.unionByName(offline.withColumn("value", F.lit(0).cast("bigint")))
        self.online.write(online.groupBy("user").agg(F.max("value").alias("value")), batch_id)

    def _names(self, active: DataFrame, users: DataFrame | None, batch_id: int) -> LabelRegistry | None:
        if self.registry is None:
            return None
        if isinstance(self.registry, SharedRegistry):
            return self.registry.extend("snapshots", batch_id, labels.snapshot_sightings(active, users))
        known = self.registry if batch_id == 0 else LabelRegistry(self.names.before(batch_id), self.registry.caps)
        grown = labels.extend_registry(known, labels.snapshot_sightings(active, users))
        self.names.write(grown.rows, batch_id)
        return LabelRegistry(self.names.after(batch_id), self.registry.caps)
