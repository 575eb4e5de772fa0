"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, filter_audit, html_text, image_copies, jaccard_join, language, licenses, packing, pii, prefix_trie, quality, shards, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_pii": pii.op3_pii,
        "op4_image_copies": image_copies.op4_image_copies,
        "op5_quality": quality.op5_quality,
        "op6_language": language.op6_language,
        "op7_virtual_slots": shards.op7_virtual_slots,
        "op8_packing": packing.op8_packing,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_licenses": licenses.op13_licenses,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.OP2_SQL,
        "op10_jaccard_join": jaccard_join.OP10_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_licenses": licenses.OP13_SQL,
    }
