"""The queries of this package by name, and the SQL of those that SQL can express.

The others need XXH64, tokenizers, keyed hashes of matches, sampling or training, which DuckDB does not
have; tests/llm holds them against brute force or held-out accuracy.
"""

from __future__ import annotations

from learnspark.llm import collocations, embedding_dedup, packing, piece_fst, pitman_yor, prefix_trie, quality_classifier, quality_rules, quote_threads, rendezvous, simhash, substring_dedup, surrogates
from learnspark.llm.sql import ORACLE_SQL

QUERIES = {
    "op1_quote_threads": quote_threads.op1_quote_threads,
    "op2_simhash": simhash.op2_simhash,
    "op3_substring": substring_dedup.op3_substring,
    "op4_surrogates": surrogates.op4_surrogates,
    "op5_int8_tiles": embedding_dedup.op5_int8_tiles,
    "op6_rendezvous": rendezvous.op6_rendezvous,
    "op7_pitman_yor": pitman_yor.op7_pitman_yor,
    "op8_packing": packing.op8_packing,
    "op9_piece_fst": piece_fst.op9_piece_fst,
    "op10_risk_rules": quality_rules.op10_risk_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_quality": quality_classifier.op13_quality,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
