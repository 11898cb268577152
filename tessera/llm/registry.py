"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from . import chat, decontaminate, divergence, jaccard, licenses, lm, packing, prefix_trie, quality, secrets, substring, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_secrets": secrets.op4_secrets,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_licenses": licenses.op7_licenses,
        "op8_packing": packing.op8_packing,
        "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
        "op10_lm_scores": lm.op10_lm_scores,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_chat_format": chat.op12_chat_format,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op6_decontamination": decontaminate.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_chat_format": chat.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
