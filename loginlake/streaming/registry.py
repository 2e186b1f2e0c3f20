"""One label registry for all streams of an application."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.labels import LabelRegistry, extend_registry
from ..operators.storage import delete_tree, move_in, names_in
from ..schemas import LABEL_CAPS

_ROWS = "dimension string, value string, display string, position int"
_LOCK = threading.Lock()  # streams of an application run their batches in one driver


@dataclass(frozen=True)
class SharedRegistry:
    """Versions of a registry, each named after the stream and micro-batch that made it.

    Streams extend the newest version in turn, so the caps hold for all of them together and a name once given
    stays. A repeated batch finds its own version. Kept are the newest version and the last of each stream.
    """

    spark: SparkSession
    path: str
    caps: dict[str, int] = field(default_factory=lambda: dict(LABEL_CAPS))

    def _versions(self) -> list[tuple[int, str, int, str]]:
        """(number, stream, batch, folder name), oldest first."""
        found = []
        for name in names_in(self.spark, self.path, create=True):
            number, stream, batch = name.split("~")
            found.append((int(number), stream, int(batch), name))
        return sorted(found)

    def _read(self, name: str) -> LabelRegistry:
        return LabelRegistry(self.spark.read.schema(_ROWS).parquet(f"{self.path}/{name}"), self.caps)

    def latest(self) -> LabelRegistry:
        versions = self._versions()
        return self._read(versions[-1][3]) if versions else LabelRegistry(self.spark.createDataFrame([], _ROWS), self.caps)

    def of(self, stream: str, batch_id: int) -> LabelRegistry:
        """The version that a batch of a stream made."""
        return self._read(next(v[3] for v in self._versions() if v[1:3] == (stream, batch_id)))

    def extend(self, stream: str, batch_id: int, sightings: DataFrame) -> LabelRegistry:
        """Gives free places to new values of a batch; the version to label the batch with."""
        with _LOCK:
            versions = self._versions()
            if not any(v[1:3] == (stream, batch_id) for v in versions):
                number = versions[-1][0] + 1 if versions else 0
                staged = f"{self.path}-staged"
                grown = extend_registry(self.latest(), sightings).rows
                grown.write.mode("overwrite").parquet(staged)
                move_in(self.spark, staged, f"{self.path}/{number:010d}~{stream}~{batch_id}")
                last = {v[1]: v for v in versions if v[1] != stream}
                for old in versions:
                    if old not in last.values():
                        delete_tree(self.spark, f"{self.path}/{old[3]}")
            return self.of(stream, batch_id)
