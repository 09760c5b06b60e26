"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, edit_counts, exact_dedup, quality, repeats, secrets, sentencepiece_codec, simhash, source_divergence, spelling, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_quality": quality.query,
        "op3_simhash": simhash.query,
        "op4_decontaminate": decontaminate.query,
        "op5_toxicity": toxicity.query,
        "op6_edit_counts": edit_counts.query,
        "op7_repeats": repeats.query,
        "op8_token_files": token_files.query,
        "op9_secrets": secrets.query,
        "op10_sentencepiece": sentencepiece_codec.query,
        "op11_source_divergence": source_divergence.query,
        "op12_warc": warc.query,
        "op13_spelling": spelling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op4_decontaminate": decontaminate.SQL,
        "op7_repeats": repeats.SQL,
        "op11_source_divergence": source_divergence.SQL,
        "op12_warc": warc.SQL,
        "op13_spelling": spelling.SQL,
    }
