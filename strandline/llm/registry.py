"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, licenses, quality, secrets, sentencepiece_codec, simhash, substrings, toxicity, wavelet

_QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_wavelet": wavelet.op2_wavelet,
    "op3_substrings": substrings.op3_substrings,
    "op4_chat": chat.op4_chat,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_licenses": licenses.op7_licenses,
    "op8_secrets": secrets.op8_secrets,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
}
_SQL: dict[str, str] = {
    "op3_substrings": substrings.OP3_SQL,
    "op4_chat": chat.OP4_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op6_quality": quality.OP6_SQL,
    "op7_licenses": licenses.OP7_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
