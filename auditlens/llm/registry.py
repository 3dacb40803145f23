"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat, conv_repair, cover_tree, exact_dedup, filter_audit, hmm_lm, html_extract, langid, packing, simhash, suffix_dedup, token_shards

QUERIES = {
    "op1_hmm_scoring": hmm_lm.op1_hmm_scoring,
    "op2_language_id": langid.op2_language_id,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_token_shards": token_shards.op4_token_shards,
    "op5_harmonic_packing": packing.op5_harmonic_packing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_perspective_rotation": chat.op9_perspective_rotation,
    "op10_cover_tree": cover_tree.op10_cover_tree,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": conv_repair.op12_conversation_repair,
    "op13_html_extraction": html_extract.op13_html_extraction,
    "lm_base_scores": hmm_lm.lm_base_scores,
}
ORACLE = {
    "op6_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_perspective_rotation": chat.ORACLE_SQL,
    "op10_cover_tree": cover_tree.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_conversation_repair": conv_repair.ORACLE_SQL,
    "lm_base_scores": hmm_lm.BASE_SCORES_SQL,
}
