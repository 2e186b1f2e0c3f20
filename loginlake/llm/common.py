"""Shared parts of the corpus operators: stored tables, Arrow batches, input tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.storage import checkpoint_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session on one machine without one (tests) gets its own."""
    return checkpoint_folder(spark)


class Store:
    """Tables of one operator call, as Parquet in the shared folder: they cut lineage and
    survive lost executors. A table is dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path, **options)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._loginlake_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        context = self.spark.sparkContext
        for table in tables:
            path = context._jvm.org.apache.hadoop.fs.Path(table._loginlake_path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict[str, object]]]], schema: str | StructType
) -> DataFrame:
    """Applies a function of one Arrow batch to each batch of a partition. make() builds the
    function once per task; it yields dicts of columns, and rows keep no other state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for columns in apply(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type)
                        for v, f in zip(columns.values(), arrow, strict=True)
                    ],
                    schema=arrow,
                )

    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(parsed)
    return df.mapInArrow(run, parsed)


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def fold(column: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column) % folds, F.lit(0))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
