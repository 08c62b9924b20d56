"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quarry.llm import chat_template, decontamination, filter_audit, jaccard, language_id, merkle, pii, quality, sentencepiece_lattice, sharding, simhash, token_counts, toxicity
from quarry.llm.oracle import DECONTAMINATION_SQL, JACCARD_SQL

QUERIES = {
    "op1_pii": pii.op1,
    "op2_ngram_jaccard_join": jaccard.op2,
    "op2_ngram_jaccard_links": jaccard.op2_links,
    "op3_chat_formatting": chat_template.op3,
    "op4_benchmark_decontamination": decontamination.op4,
    "op5_toxicity": toxicity.op5,
    "op6_sharding": sharding.op6,
    "op7_token_counts": token_counts.op7,
    "op8_sentencepiece": sentencepiece_lattice.op8,
    "op9_language_id": language_id.op9,
    "op10_quality_rules": quality.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_simhash": simhash.op12,
    "op13_merkle_manifest": merkle.op13,
}
ORACLE_SQL = {
    "op2_ngram_jaccard_join": JACCARD_SQL,
    "op3_chat_formatting": chat_template.OP3_SQL,
    "op4_benchmark_decontamination": DECONTAMINATION_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
