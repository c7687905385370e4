"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, line_dedup, ngram_join, rules, suffix_dedup
from .bpe import op1_bpe
from .chat import op8_chat_format
from .decontam import op3_decontamination
from .line_dedup import op10_line_dedup
from .ngram_join import op7_ngram_join
from .quality import op4_quality_classifier
from .rules import op6_quality_rules
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op9_toxicity
from .warc import op2_warc


OPERATORS = (
    op1_bpe,
    op2_warc,
    op3_decontamination,
    op4_quality_classifier,
    op5_suffix_dedup,
    op6_quality_rules,
    op7_ngram_join,
    op8_chat_format,
    op9_toxicity,
    op10_line_dedup,
    rules.quality_rules_high_risk,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express; the others are held against brute force, round trips or held-out labels in tests."""
    return {
        "op5_suffix_dedup": suffix_dedup.ORACLE,
        "op6_quality_rules": rules.ORACLE,
        "quality_rules_high_risk": rules.HIGH_RISK_ORACLE,
        "op7_ngram_join": ngram_join.ORACLE,
        "op8_chat_format": chat.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
    }
