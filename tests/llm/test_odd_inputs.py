"""Every query and stage over odd rows and over empty tables."""

import pytest

import corpus_pipeline
from loginlake.llm import catalog

from .conftest import odd_rows

PER_ROW = ["op1_toxicity", "op4_suffix_dedup", "op5_bpe", "op6_quality", "op7_language_id", "op8_simhash", "op9_secret_scan", "op12_token_files", "op13_fill_in_middle"]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, folder, name):
    query = catalog.queries()[name]
    rows = query(spark, folder["full"]).collect()
    if name in PER_ROW:
        key = lambda x: (x is None, x or 0)
        assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in odd_rows()), key=key)
    assert query(spark, folder["empty"]).count() == 0


def test_stages_keep_columns_of_any_name(spark, folder):
    """Columns called like those that stages add on the way come out as they went in."""
    from pyspark.sql import functions as F

    names = ("stage_lang", "stage_score", "stage_fp", "chosen_fp", "chosen_id", "chosen_rows", "stage_matches", "Stage_Spans")
    docs = spark.read.parquet(f"{folder['full']}/documents.parquet").where("doc_id < 12")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder["full"])
        assert after.dtypes == docs.dtypes
        rows = after.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)


def test_pipeline(spark, folder):
    before = spark.read.parquet(f"{folder['full']}/documents.parquet")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder["full"])
        assert after.columns == columns and after.dtypes == before.dtypes
        assert stage(spark, before.limit(0), folder["full"]).count() == 0
    out = corpus_pipeline.run(spark, folder["full"])
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 5 in ids and 6 not in ids and ids.count(5) == 1
    assert {1, 2, 3, 4}.isdisjoint(ids)
    assert corpus_pipeline.run(spark, folder["empty"]).count() == 0
