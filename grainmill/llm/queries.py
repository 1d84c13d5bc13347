"""The queries of this package and their SQL, by key."""

from __future__ import annotations

from grainmill.llm import decontaminate, html_text, image_copies, language_id, line_dedup, merkle, near_dedup, packing, prefix_trie, secrets, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_zstd_novelty_secrets": secrets.op1_zstd_novelty_secrets,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op6_hierarchical_language_id": language_id.op6_hierarchical_language_id,
    "op7_local_descriptor_copies": image_copies.op7_local_descriptor_copies,
    "op8_site_style_tree": html_text.op8_site_style_tree,
    "op10_odd_sketch_near_dedup": near_dedup.op10_odd_sketch_near_dedup,
    "op3_cnn_toxicity": toxicity.op3_cnn_toxicity,
    "op4_containment_decontamination": decontaminate.op4_containment_decontamination,
    "op5_dp_packing": packing.op5_dp_packing,
    "op9_deep_shallow_suffix_dedup": suffix_dedup.op9_deep_shallow_suffix_dedup,
    "op11_term_at_a_time_topk": topk_search.op11_term_at_a_time_topk,
    "op12_louds_prefix_trie": prefix_trie.op12_louds_prefix_trie,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op4_containment_decontamination": decontaminate.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op10_odd_sketch_near_dedup": near_dedup.SQL,
    "op11_term_at_a_time_topk": topk_search.SQL,
    "op12_louds_prefix_trie": prefix_trie.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
