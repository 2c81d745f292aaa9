"""Queries of the training-data operators and, where SQL can express one, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe_roundtrip
from .chat_format import OP2_SQL, op2_chat_format
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .licenses import op5_license_scan, op5_sql
from .minhash import op4_near_dedup
from .packing import op9_packing
from .quality_rules import op10_quality_rules
from .substring_dedup import op7_substring_dedup
from .token_files import op6_token_files

from .toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_roundtrip": op1_bpe_roundtrip,
        "op2_chat_format": op2_chat_format,
        "op3_toxicity": op3_toxicity,
        "op4_near_dedup": op4_near_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_token_files": op6_token_files,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op5_license_scan": op5_sql(), "op8_exact_dedup": OP8_SQL}
