"""Queries of the operators over the given tables, and the SQL of those that SQL can express."""

from voltfleet.llm import (
    fingerprints,
    infilling,
    jaccard,
    language_id,
    maxscore,
    mixing,
    packing,
    prefix_trie,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_language_id": language_id.op2_language_id,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_exact_top_k": maxscore.op11_exact_top_k,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op3_url_filters": url_filters.ORACLE,
    "op4_ngram_jaccard_join": jaccard.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op6_fingerprints": fingerprints.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_exact_top_k": maxscore.ORACLE,
    "op12_fill_in_middle": infilling.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
