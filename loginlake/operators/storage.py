"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints: spark.checkpoint.dir, or the one set on the context.

    A session on one machine with neither gets a folder of its own, which stays its setting from
    then on; a cluster must name one that all machines share, else this is an error.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or own_folder(context.master))
    return named or context.getCheckpointDir()


def own_folder(master: str) -> str:
    """A new folder of this machine, for sessions whose tasks all run on it."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return tempfile.mkdtemp(prefix="loginlake-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back by everything built on it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _path(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str, create: bool = False) -> list[str]:
    """Names of what lies in a folder, without hidden files; none if there is no folder."""
    path, files = _path(spark, folder)
    if create:
        files.mkdirs(path)
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(n for n in (f.getPath().getName() for f in found) if n[0] not in "._")


def move_in(spark: SparkSession, folder: str, target: str) -> None:
    """Gives a finished folder its final name, under which it appears whole."""
    source, files = _path(spark, folder)
    if not files.rename(source, _path(spark, target)[0]):
        raise OSError(f"cannot move {folder} to {target}")


def delete_tree(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)
