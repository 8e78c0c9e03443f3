"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import arrow_stream, bpe_tree, divergence, exact_dedup, language_id, lsh_forest, packing, pq_dedup, prefix_trie, quality_net, secret_scan, suffix_dedup, token_counts

QUERIES = {
    "op1_secret_ledger": secret_scan.op1,
    "op2_pq_vectors": pq_dedup.op2,
    "op3_token_counts": token_counts.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_radix_dedup": exact_dedup.op5,
    "op6_arrow_stream": arrow_stream.op6,
    "op7_language_id": language_id.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_lsh_forest": lsh_forest.op9,
    "op10_bpe_tree": bpe_tree.op10,
    "op11_byte_network": quality_net.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_source_divergence": divergence.op13,
}

SQL = {
    "op1_secret_ledger": secret_scan.OP1_SQL,
    "op2_pq_vectors": pq_dedup.OP2_SQL,
    "op5_radix_dedup": exact_dedup.OP5_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
