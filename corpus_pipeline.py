"""Documents to token ids: language ID, near duplicates, benchmark passages, secrets, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loginlake.llm.common import Store, read_table
from loginlake.llm.stages import STAGES

#: SQL cannot express rank-order profiles or byte-pair merges; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again."""
    docs, store, before = read_table(spark, sf_dir, "documents"), Store(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            store.drop(before)
        before = docs
    return docs
