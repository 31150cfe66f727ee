"""The queries of this folder, the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing, byte_bpe, embedding_whitening, fill_in_middle, html_extraction, language_id, line_dedup, nearest_neighbours, ngram_jaccard, quality_rules, substring_dedup, url_filters, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_nearest_neighbours": nearest_neighbours.op2_nearest_neighbours,
        "op3_warc": warc.op3_warc,
        "op4_url_filters": url_filters.op4_url_filters,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
        "op7_html_extraction": html_extraction.op7_html_extraction,
        "op8_best_fit_packing": best_fit_packing.op8_best_fit_packing,
        "op9_language_id": language_id.op9_language_id,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_embedding_whitening": embedding_whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op4_url_filters": url_filters.SQL, "op5_quality_rules": quality_rules.SQL, "op11_fill_in_middle": fill_in_middle.SQL}
