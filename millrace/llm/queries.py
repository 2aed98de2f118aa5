"""The registered queries of this folder: each operator over its whole table, with its DuckDB text if any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import (
    conversation_trie,
    html_extract,
    lexical_search,
    license_scan,
    mixing,
    packing,
    quality_model,
    quality_rules,
    simhash,
    token_counts,
    toxicity,
    vector_search,
    warc,
)
from millrace.llm.common import table


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[table(spark, sf_dir, t) for t in tables])


FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": _over(html_extract.extracted, "pages"),
    "op2_toxicity": _over(toxicity.scored, "documents", "labels"),
    "op3_source_mixing": _over(mixing.mixed, "documents"),
    "op4_exact_top_k": _over(vector_search.searched, "embeddings"),
    "op5_warc": _over(warc.archived, "pages"),
    "op6_simhash": _over(simhash.near_duplicates, "documents"),
    "op7_best_fit_packing": _over(packing.packed, "documents"),
    "op8_token_counts": _over(token_counts.counted, "documents"),
    "op9_quality_classifier": _over(quality_model.scored, "documents", "labels"),
    "op10_quality_rules": _over(quality_rules.ruled, "documents"),
    "op11_lexical_search": _over(lexical_search.searched, "documents", "benchmark"),
    "op12_license_scans": _over(license_scan.scanned, "documents"),
    "op13_conversation_trie": _over(conversation_trie.nodes, "conversations"),
}

ORACLE: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE,
    "op4_exact_top_k": vector_search.ORACLE,
    "op5_warc": warc.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
