"""Queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm.centroids import OP11_SQL, op11_centroid_clustering
from lexforge.llm.harmonic import op12_harmonic_packing
from lexforge.llm.html_render import op8_html_render
from lexforge.llm.line_dedup import OP7_SQL, op7_line_dedup
from lexforge.llm.lm_scoring import op4_lm_scoring
from lexforge.llm.ngram_join import OP5_SQL, op5_ngram_join
from lexforge.llm.packing import op6_packing
from lexforge.llm.quality_classifier import op1_compression_quality
from lexforge.llm.quality_rules import op2_quality_rules
from lexforge.llm.sp_codec import op10_sp_codec
from lexforge.llm.suffix_dedup import OP9_SQL, op9_suffix_dedup
from lexforge.llm.survivorship import OP13_SQL, op13_golden_record
from lexforge.llm.topk_search import OP3_SQL, op3_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": op1_compression_quality,
    "op2_quality_rules": op2_quality_rules,
    "op3_topk_search": op3_topk_search,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_ngram_join": op5_ngram_join,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_render": op8_html_render,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sp_codec": op10_sp_codec,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_harmonic_packing": op12_harmonic_packing,
    "op13_golden_record": op13_golden_record,
}
ORACLE: dict[str, str] = {"op3_topk_search": OP3_SQL, "op5_ngram_join": OP5_SQL, "op7_line_dedup": OP7_SQL, "op9_suffix_dedup": OP9_SQL, "op11_centroid_clustering": OP11_SQL, "op13_golden_record": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
