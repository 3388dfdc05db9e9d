"""The registered queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from . import bpe, chat, divergence, embeddings, langid, linededup, mixing, mixlm, simhash, spelling, substrings, vafile, wrappers

QUERIES = {
    "op1_rp_forest": embeddings.op1_rp_forest,
    "op2_simhash_bktree": simhash.op2_simhash_bktree,
    "op3_wrapper_induction": wrappers.op3_wrapper_induction,
    "op4_context_mixing": mixlm.op4_context_mixing,
    "op5_pivotal_mix": mixing.op5_pivotal_mix,
    "op6_vafile_topk": vafile.op6_vafile_topk,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_language_mixture": langid.op9_language_mixture,
    "op10_line_templates": linededup.op10_line_templates,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_rp_forest": embeddings.ORACLE,
    "op6_vafile_topk": vafile.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_chat_formatting": chat.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
