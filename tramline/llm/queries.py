"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Module, query function, name of its SQL in the module (or None).
TABLE = [
    ("spm", "op1_sentencepiece", None),
    ("topk", "op2_exact_topk", "OP2_SQL"),
    ("lang_id", "op3_language_id", None),
    ("lm_score", "op4_lm_scoring", "OP4_SQL"),
    ("mixing", "op5_source_mixing", "OP5_SQL"),
    ("minhash_dedup", "op6_minhash_dedup", "OP6_SQL"),
    ("chat_format", "op7_chat_formatting", "OP7_SQL"),
    ("suffix_dedup", "op8_suffix_dedup", "OP8_SQL"),
    ("ann", "op9_nearest_neighbours", None),
    ("url_filters", "op10_url_filters", "OP10_SQL"),
    ("merkle", "op11_merkle_manifest", "OP11_SQL"),
    ("fingerprints", "op12_document_fingerprints", None),
    ("runs", "op13_periodic_runs", None),
]


def queries() -> dict:
    return {name: getattr(import_module(f"tramline.llm.{module}"), name) for module, name, _ in TABLE}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"tramline.llm.{module}"), sql) for module, name, sql in TABLE if sql}
