"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from medgrain.llm import (
    alignment, bin_packing, byte_bpe, chat_tree, exact_dedup, jaccard_join, language_id, mixing, order_minhash, prefix_trie,
    token_files, topk_search, toxicity,
)

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_chat_tree": chat_tree.op2_chat_tree,
    "op3_order_minhash": order_minhash.op3_order_minhash,
    "op4_token_files": token_files.op4_token_files,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bin_packing": bin_packing.op7_bin_packing,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_topk_search": topk_search.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
