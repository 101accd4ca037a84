"""Names of this subpackage's queries and their SQL."""

from __future__ import annotations

from tracelake.llm import queries as q
from tracelake.llm import sql

_NAMES = [
    "op1_line_dedup",
    "op2_simhash_near_dedup",
    "op3_embedding_near_dedup",
    "op4_url_lists",
    "op5_decontamination",
    "op6_token_files",
    "op7_toxicity",
    "op8_arc_to_warc",
    "op9_quality_knn",
    "op10_byte_bpe",
    "op11_repeated_passages",
    "op12_conversation_repair",
    "op13_source_divergence",
]


def queries() -> dict:
    return {name: getattr(q, name) for name in _NAMES}


def oracle_sql() -> dict:
    return dict(sql.ORACLE)
