"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from graphloom.llm import bpe_words, decontamination, html_text, jaccard_join, language_id, packing, prefix_trie, quality_rules, quotations, substring_dedup, token_store, warc, whitening


def queries() -> dict:
    return {
        "op1_quotations": quotations.op1_quotations,
        "quotations_derived": quotations.quotations_derived,
        "op2_warc": warc.op2_warc,
        "op3_language_id": language_id.op3_language_id,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_packing": packing.op6_packing,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_token_store": token_store.op8_token_store,
        "op9_html_text": html_text.op9_html_text,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_bpe_words": bpe_words.op12_bpe_words,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op4_jaccard_join": jaccard_join.ORACLE_SQL,
        "op5_quality_rules": quality_rules.ORACLE_SQL,
        "op7_decontamination": decontamination.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    }
