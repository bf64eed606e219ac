"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_repair, exact_dedup, fill_in_middle, language_id, license_scan, media_columns, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_language_id": language_id.op2_language_id,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_media_columns": media_columns.op4_media_columns,
        "op5_packing": packing.op5_packing,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_bpe": bpe.op7_bpe,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_quality_rules": quality_rules.op9_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op3_license_scan": license_scan.oracle(),
        "op9_quality_rules": quality_rules.ORACLE_SQL,
    }
