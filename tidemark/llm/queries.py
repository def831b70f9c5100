"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontam, lang_id, line_dedup, packing, simhash, suffix_dedup, token_output, topk, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        url_filter.op1_url_filter,
        lang_id.op2_language_id,
        line_dedup.op3_line_dedup,
        chat_format.op4_chat_format,
        simhash.op5_simhash_near_dedup,
        topk.op6_exact_top_k,
        packing.op7_best_fit_packing,
        suffix_dedup.op8_suffix_dedup,
        decontam.op9_benchmark_decontamination,
        token_output.op10_token_output,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    modules = {"op1_url_filter": url_filter, "op3_line_dedup": line_dedup, "op4_chat_format": chat_format, "op6_exact_top_k": topk, "op8_suffix_dedup": suffix_dedup}
    return {name: m.SQL for name, m in modules.items()}
