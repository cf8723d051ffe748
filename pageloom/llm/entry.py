"""Queries and DuckDB SQL of this subpackage, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pageloom.llm import chat, fingerprints, langid, neardup, packing, pieces, quality, secrets, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_packing": packing.op2_packing,
        "op3_language_id": langid.op3_language_id,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op5_minhash_near_dedup": neardup.op5_minhash_near_dedup,
        "op6_warc": warc.op6_warc,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op4_secret_scans": secrets.OP4_SQL,
        "op6_warc": warc.OP6_SQL,
        "op9_chat_formatting": chat.OP9_SQL,
    }
