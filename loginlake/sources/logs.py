"""Rotated log files as a table of lines in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .integrity import DAMAGED, UNREADABLE, LogFiles


def _name_filter(log_file: str) -> str:
    return f"{{{log_file},{log_file}.*}}"


def file_rank(file_name: Column, log_file: str) -> Column:
    """0 for the live file, the number behind its name for a rotated one, else 999."""
    prefix = f"{log_file}."
    suffix = F.regexp_replace(F.substr(file_name, F.lit(len(prefix) + 1)), r"\.gz", "")
    return F.when(file_name == log_file, F.lit(0)).otherwise(
        F.coalesce(F.when(suffix.rlike(r"^[+-]?\d+$"), suffix.try_cast("bigint")), F.lit(999))
    ).cast("bigint")


def arrival_seq(log_file: str) -> Column:
    """Order of a line: rank of its file (oldest first), then its place inside the file.

    A file is cut into blocks and each block is read front to back by one task, so
    block start and row id put the lines of a file back into their order.
    """
    meta = F.col("_metadata")
    return F.struct(
        (-file_rank(meta.file_name, log_file)).alias("file_order"),
        F.xxhash64(meta.file_path).alias("file_id"),
        meta.file_block_start.alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def read_logs(
    spark: SparkSession,
    log_dir: str,
    log_file: str = "auth.log",
    tolerant: bool = True,
    recursive: bool = False,
) -> DataFrame:
    """Lines (value, file_name, file_path, seq) of ``log_file`` and its rotated, maybe gzipped, copies.

    A damaged file gives the lines before the damage; ``tolerant=False`` fails instead.
    ``recursive`` reads a tree with one directory per host.
    """
    reader = (
        spark.read.option("pathGlobFilter", _name_filter(log_file))
        .option("ignoreCorruptFiles", tolerant)
        .option("ignoreMissingFiles", tolerant)
        .option("recursiveFileLookup", recursive)
    )
    lines = reader.text(log_dir)
    return lines.select(
        "value",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        arrival_seq(log_file).alias("seq"),
    )


def list_logs(
    spark: SparkSession, log_dir: str, log_file: str = "auth.log", recursive: bool = False
) -> DataFrame:
    """(file_path, file_name, bytes, state) of the files ``read_logs`` takes, empty ones too.

    ``state`` is ``whole``, ``damaged`` (a gzip file that does not inflate to its end) or ``unreadable``.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(log_dir)
    folder = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    spark.dataSource.register(LogFiles)
    reader = spark.read.format("log_files").option("path", folder).option("log_file", log_file)
    return reader.option("recursive", recursive).load()


def ingest_report(lines: DataFrame, recognised: Column, files: DataFrame | None = None) -> DataFrame:
    """One row per file: its lines, those recognised (auth_lines), and a status.

    Without the listing in ``files`` only names are known and the status is ``unchecked``. With
    it, files are told apart by path; one that is damaged or unreadable, or has bytes but gave no
    line, is ``degraded``.
    """
    counted = [F.count(F.lit(1)).alias("lines"), F.count_if(recognised).alias("auth_lines")]
    if files is None:
        return lines.groupBy("file_name").agg(*counted).withColumn("status", F.lit("unchecked"))
    counts = lines.groupBy("file_path").agg(*counted)
    # a gzip file of nothing but head and trailer has bytes and is whole
    lost = F.col("state").isin(DAMAGED, UNREADABLE) | (
        F.col("lines").isNull() & (F.col("bytes") > 0) & ~F.col("file_name").endswith(".gz")
    )
    return files.join(counts, "file_path", "left").select(
        "file_path",
        "file_name",
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("auth_lines", F.lit(0)).alias("auth_lines"),
        F.when(lost, "degraded").otherwise("ok").alias("status"),
    )


def ingest_status(report: DataFrame) -> DataFrame:
    """One row (status, files, lines, first_failed), the latter a path if paths are known.

    ``degraded`` if a file is or there is none, else ``unchecked`` if a file is, else ``ok``.
    """
    name = "file_path" if "file_path" in report.columns else "file_name"
    return report.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.count_if(F.col("status") == "unchecked").alias("unchecked"),
        F.min(F.when(F.col("status") == "degraded", F.col(name))).alias("first_failed"),
    ).select(
        F.when((F.col("files") == 0) | F.col("first_failed").isNotNull(), "degraded")
        .when(F.col("unchecked") > 0, "unchecked")
        .otherwise("ok")
        .alias("status"),
        "files",
        "lines",
        "first_failed",
    )
