"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .class_lm import op10_class_bigrams
from .decontamination import op2_benchmark_leaks
from .jaccard_join import op8_jaccard_classes
from .license_scan import op6_license_scan
from .quality_rules import op3_line_crf
from .sharding import op5_interleaved_shards
from .source_mixing import op4_mix_sources
from .sql import JACCARD_SQL, mixing_sql, sharding_sql
from .substring_dedup import ORACLE_SQL as OP1_SQL
from .substring_dedup import op1_line_dedup
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup,
            op2_benchmark_leaks,
            op3_line_crf,
            op4_mix_sources,
            op5_interleaved_shards,
            op6_license_scan,
            op7_suffix_dedup,
            op8_jaccard_classes,
            op9_token_counts,
            op10_class_bigrams,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_mix_sources": mixing_sql(), "op5_interleaved_shards": sharding_sql(), "op8_jaccard_classes": JACCARD_SQL}
