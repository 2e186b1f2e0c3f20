"""Bounded pieces of a key's arrival order.

One process id may own a third of a log, so no window here is partitioned by
(host, pid) over raw rows.  A key's rows are cut into chunks of arrival order, the
windows run per (host, pid, chunk), and only a few boundary rows per chunk go
through a second window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

KEY = ("host", "pid")
# never NULL, so that joins on the key add no filter and can share its shuffle
KEY_VALUES = ("coalesce(host, '') AS host", "coalesce(pid, '') AS pid")
CHUNK_BITS = 20  # at most 2**20 arrival positions in a chunk


def add_chunk(df: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds the chunk of a row: its block of 2**bits positions, never across two file blocks."""
    order = df.schema["seq"].dataType
    if not isinstance(order, StructType):
        return df.withColumn("chunk", F.expr(f"coalesce(shiftright(seq, {bits}), 0)"))
    *outer, row_id = order.names
    # the low 33 bits of a row id count the rows of one task
    part = f"shiftright(seq.{row_id} & {(1 << 33) - 1}, {bits}) AS part"
    return df.withColumn("chunk", F.expr(f"struct({', '.join('seq.' + n for n in outer)}, {part})"))


# window clauses: rows of a key inside one chunk, and boundary rows of the whole key
IN_CHUNK = "PARTITION BY host, pid, chunk ORDER BY seq"
IN_KEY = "PARTITION BY host, pid ORDER BY seq"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def following(
    df: DataFrame, key: str, order: str, value: Column, name: str, chunk: Column
) -> DataFrame:
    """Adds ``name``: ``value`` of the key's next row by ``order`` (NULL on its last row)."""
    near = Window.partitionBy(key, "_chunk").orderBy(order)
    far = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_chunk", chunk).withColumn("_value", F.struct(value.alias("v")))
    rows = rows.withColumn("_next", F.lead("_value").over(near)).withColumn(
        "_first", F.row_number().over(near) == 1
    )
    inner = rows.filter(F.col("_next").isNotNull())
    edge = rows.filter(F.col("_next").isNull() | F.col("_first"))
    edge = edge.withColumn("_far", F.lead("_value").over(far)).filter(F.col("_next").isNull())
    both = inner.unionByName(edge.withColumn("_next", F.col("_far")).drop("_far"))
    return both.withColumn(name, F.col("_next.v")).drop("_chunk", "_value", "_next", "_first")
