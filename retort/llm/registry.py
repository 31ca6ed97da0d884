"""The queries of this subpackage and, where SQL can express one, the SQL."""

from __future__ import annotations

from retort.llm import chat_format, decontaminate, language_id, pii, quality_classifier, quality_rules, secret_scan, sentencepiece_lattice, simhash, suffix_dedup

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_sentencepiece_nbest": sentencepiece_lattice.op4_sentencepiece_nbest,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_pii": pii.op8_pii,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}
ORACLE_SQL = {"op1_chat_formatting": chat_format.OP1_SQL, "op5_suffix_dedup": suffix_dedup.OP5_SQL}
