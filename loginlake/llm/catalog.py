"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    decontaminate,
    fill_in_middle,
    language_id,
    line_dedup,
    prefix_trie,
    pseudonyms,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_pseudonyms": pseudonyms.op3_pseudonyms,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_bpe": bpe.op5_bpe,
        "op6_quality": quality.op6_quality,
        "op7_language_id": language_id.op7_language_id,
        "op8_simhash": simhash.op8_simhash,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_token_files": token_files.op12_token_files,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
