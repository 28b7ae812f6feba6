"""Queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallysheet.llm import bpe, chat, embedding_dedup, exact_dedup, filter_audit, html_text, language, merkle, mixing, quality, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.dedup_query,
    "op2_language": language.language_query,
    "op3_embedding_dedup": embedding_dedup.embedding_query,
    "op4_bpe": bpe.bpe_query,
    "op5_simhash": simhash.simhash_query,
    "op6_chat": chat.chat_query,
    "op7_toxicity": toxicity.toxicity_query,
    "op8_mixing": mixing.mix_query,
    "mix_targets": mixing.targets_query,
    "op9_quality": quality.quality_query,
    "op10_html": html_text.html_query,
    "op11_suffix_dedup": suffix_dedup.suffix_query,
    "op12_merkle": merkle.merkle_query,
    "op13_filter_audit": filter_audit.audit_query,
    "chat_quoted_documents": chat.quoted_query,
}

ORACLE_SQL = {"op1_exact_dedup": exact_dedup.DEDUP_SQL, "op3_embedding_dedup": embedding_dedup.EMBEDDING_SQL, "op6_chat": chat.CHAT_SQL, "mix_targets": mixing.TARGETS_SQL, "op12_merkle": merkle.MERKLE_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL, "chat_quoted_documents": chat.QUOTED_SQL}
