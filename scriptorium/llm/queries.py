"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import op1_html, op2_packing, op3_warc, op4_toxicity, op5_quality, op6_pii, op7_mtree, op8_minhash, op9_token_orc, op10_decontaminate, op11_prefix_trie, op12_collocations, op13_onebit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html.query,
        "op2_best_fit_packing": op2_packing.query,
        "op3_warc_revisits": op3_warc.query,
        "op4_toxicity": op4_toxicity.query,
        "op5_quality": op5_quality.query,
        "op6_pii_spans": op6_pii.query,
        "op7_mtree_topk": op7_mtree.query,
        "op8_minhash_dedup": op8_minhash.query,
        "op9_token_orc": op9_token_orc.query,
        "op10_decontamination": op10_decontaminate.query,
        "op11_prefix_trie": op11_prefix_trie.query,
        "op12_collocations": op12_collocations.query,
        "op13_onebit_neighbours": op13_onebit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_revisits": op3_warc.ORACLE_SQL,
        "op7_mtree_topk": op7_mtree.ORACLE_SQL,
        "op8_minhash_dedup": op8_minhash.ORACLE_SQL,
        "op10_decontamination": op10_decontaminate.ORACLE_SQL,
        "op11_prefix_trie": op11_prefix_trie.ORACLE_SQL,
        "op12_collocations": op12_collocations.ORACLE_SQL,
    }
