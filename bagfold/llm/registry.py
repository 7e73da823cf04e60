"""Queries of this folder and their SQL."""

from __future__ import annotations

from . import alignment, bpe, disclosure, fertility, fingerprint, lines, lm, ngram_join, packing, prefix_trie, rules_index, substring, warc

QUERIES = {
    "op1_disclosure_sanitiser": disclosure.op1_disclosure_sanitiser,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_attention_scores": lm.op12_attention_scores,
    "op13_token_alignment": alignment.op13_token_alignment,
    "op2_tokeniser_fertility": fertility.op2_tokeniser_fertility,
    "op3_url_rules": rules_index.op3_url_rules,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_improbable_features": fingerprint.op6_improbable_features,
    "op7_warc": warc.op7_warc,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
}
ORACLES = {
    "op11_prefix_trie": prefix_trie.op11_sql(),
    "op3_url_rules": rules_index.op3_sql(),
    "op4_ngram_join": ngram_join.op4_sql(),
    "op7_warc": warc.op7_sql(),
    "op8_substring_dedup": substring.op8_sql(),
    "op9_line_dedup": lines.op9_sql(),
}
