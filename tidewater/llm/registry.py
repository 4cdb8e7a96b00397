"""Queries opN_<name> of the operators and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import katz, langid, mixing, neardup, pieces, pii, quality, secrets_scan, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.query,
        "op2_private_data": pii.query,
        "op3_quality": quality.query,
        "op4_near_duplicates": neardup.query,
        "op5_near_vectors": vectors.near_query,
        "op6_katz_scores": katz.query,
        "op7_piece_encoding": pieces.query,
        "op8_secret_scan": secrets_scan.query,
        "op9_source_mixing": mixing.query,
        "op10_neighbours": vectors.search_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_duplicates": neardup.ORACLE_SQL,
        "op5_near_vectors": vectors.NEAR_SQL,
        "op9_source_mixing": mixing.ORACLE_SQL,
    }
