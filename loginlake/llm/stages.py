"""The stages of the corpus pipeline. Each takes all rows that the stage before it kept and
returns the columns of its input; only the last adds columns.

Stages return lazy tables; the caller writes them and reads them again. Documents keep their
columns whatever these are called, as columns added on the way take names that are free.

In all stages null and empty texts, ties and very long texts are as the operators say; repeated rows stay
unless the stage says otherwise, and empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, secrets, simhash
from .common import free_names, read_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told, that is those with a letter; profiles are
    learned from the given rows that have a language."""
    found = language_id.profiles(docs.where(language_id.training_rows(docs)))
    lang, score = free_names(docs, "stage_lang", "stage_score")
    told = language_id.predict(docs, found, names=(lang, score))
    return told.where(F.col(lang) != language_id.UNDETERMINED).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the least id. Repeated
    rows of it are one; among documents without an id one of the least fingerprint stays."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item is found, those without text among them."""
    (name,) = free_names(docs, "stage_matches")
    found = decontaminate.add_matches(docs, read_table(spark, sf_dir, "benchmark"), name=name)
    return found.where(F.size(name) == 0).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets are replaced by a mark, and n_chars is that of the new text. A null
    text stays null."""
    (name,) = free_names(docs, "stage_spans")
    found = secrets.scan(docs, name=name)
    text = secrets.redact(F.col("text"), F.col(name))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size(name) > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each document, its token ids, their number, and the decoded text."""
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(bpe.VOCABULARY))
    return found.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.col("decoded").cast("string").alias("decoded")
    )


STAGES = [
    ("language_id", identified),
    ("simhash", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("bpe", encoded),
]
