"""Tables written once per micro-batch, so that a repeated batch changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class BatchTable:
    """Result rows, one partition per micro-batch; a repeated batch replaces its own."""

    spark: SparkSession
    path: str

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        return self.read_batch(batch_id)

    def read_batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch_id={batch_id}")

    def read_batches(self, batches: list[int], keep: bool = False) -> DataFrame:
        """Rows of some batches; ``keep`` leaves their number in the column batch_id."""
        paths = [f"{self.path}/batch_id={b}" for b in batches]
        rows = self.spark.read.option("basePath", self.path).parquet(*paths)
        return rows.withColumn("batch_id", rows.batch_id.cast("bigint")) if keep else rows.drop("batch_id")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch_id")


@dataclass(frozen=True)
class CarriedState:
    """What one micro-batch hands to the next.

    Two slots in turn: a batch reads the slot its predecessor wrote and writes only
    the other one, so it can be repeated after a failure.
    """

    spark: SparkSession
    path: str

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/slot={batch_id % 2}")

    def before(self, batch_id: int, schema: StructType | None = None) -> DataFrame | None:
        """State left by the batch before; for the first one an empty table or None."""
        if batch_id == 0:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.after(batch_id - 1)

    def after(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/slot={batch_id % 2}")
