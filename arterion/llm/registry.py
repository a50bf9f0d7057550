"""The queries of this subpackage by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arterion.llm import conversation_repair, decontamination, language_id, licenses, line_dedup, ngram_jaccard, personal_data, quality_fm, secrets, sentencepieces, telephony, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_sentencepiece": sentencepieces.op2_sentencepiece,
        "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
        "op4_media_columns": telephony.op4_media_columns,
        "op5_quality": quality_fm.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_license_scans": licenses.op7_license_scans,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_language_id": language_id.op10_language_id,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_personal_data": personal_data.op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": secrets.ORACLE_SQL,
        "op7_license_scans": licenses.ORACLE_SQL,
        "op8_decontamination": decontamination.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op11_conversation_repair": conversation_repair.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
    }
