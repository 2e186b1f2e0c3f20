"""Login snapshots: the output of ``who``, one file or id per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sources import add_source_details, is_remote
from ..operators.enrich import latest_hostnames


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, line_no, value) with the file name as id; ids sort in time order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("snapshot_id"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )


# 1-based position of the first source token, NULL if the line names no source.
_SOURCE_START = r"""CASE
  WHEN size(tokens) < 5 THEN NULL
  WHEN endswith(element_at(tokens, -1), ')') THEN
    4 + nullif(array_position(transform(slice(tokens, 5, size(tokens)), t -> startswith(t, '(')), true), 0)
  WHEN tokens[2] RLIKE r'^\d{4}-\d{2}-\d{2}$' AND tokens[3] RLIKE r'^\d{2}:\d{2}$' THEN 5
  WHEN size(tokens) >= 6 AND tokens[2] RLIKE r'^[A-Z][a-z]{2}$' AND tokens[3] RLIKE r'^\d{1,2}$'
    AND tokens[4] RLIKE r'^\d{2}:\d{2}$' THEN 6
END"""


def parse_who(lines: DataFrame) -> DataFrame:
    """(snapshot_id, line_no, user, tty, login_time, source) of the usable lines."""
    # explode of one value: filters and projections further up do not split the line again
    tokens = r"split(regexp_replace(value, r'(?U)^\s+|\s+$', ''), r'(?U)\s+')"
    rows = lines.selectExpr("snapshot_id", "line_no", f"explode(array({tokens})) AS tokens")
    rows = rows.filter("size(tokens) >= 4").selectExpr(
        "*", f"explode(array(CAST({_SOURCE_START} AS int))) AS start"
    )
    inside = "array_join(slice(tokens, start, size(tokens)), ' ')"
    return rows.selectExpr(
        "snapshot_id",
        "line_no",
        "tokens[0] AS user",
        "tokens[1] AS tty",
        "array_join(slice(tokens, 3, coalesce(start, size(tokens) + 1) - 3), ' ') AS login_time",
        f"""CASE WHEN start IS NULL THEN ''
          WHEN endswith(element_at(tokens, -1), ')') THEN trim(BOTH '()' FROM {inside})
          ELSE tokens[start - 1] END AS source""",
    )


def active_sessions(lines: DataFrame, ptr: DataFrame | None = None) -> DataFrame:
    """Remote sessions of every snapshot with their source details."""
    rows = parse_who(lines).filter(is_remote("source"))
    name = None
    if ptr is not None:
        names = latest_hostnames(ptr)
        rows = rows.join(names, F.trim(rows.source) == names.ip, "left")
        name = "ptr_hostname"
    return add_source_details(rows, "source", name).select(
        "snapshot_id", "line_no", "user", "tty", "login_time",
        F.col("source_display").alias("source"), "source_ip", "source_hostname", "source_display",
    )
