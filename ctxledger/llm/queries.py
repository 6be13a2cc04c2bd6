"""Contract queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from ctxledger.llm import clustering, decontaminate, langid, lm, middle, neardup, packing, quality, repeats, toxicity, urlfilter, warc

QUERIES = {
    "op1_loser_tree_warc": warc.op1_loser_tree_warc,
    "op2_fast_similarity": neardup.op2_fast_similarity,
    "op3_weak_label_quality": quality.op3_weak_label_quality,
    "op4_segmented_urls": urlfilter.op4_segmented_urls,
    "op5_weak_rules": quality.op5_weak_rules,
    "op6_string_kernel_language": langid.op6_string_kernel_language,
    "op7_ppm_scoring": lm.op7_ppm_scoring,
    "op8_ngram_toxicity": toxicity.op8_ngram_toxicity,
    "op9_sum_of_squares_packing": packing.op9_sum_of_squares_packing,
    "op10_minhash_containment": decontaminate.op10_minhash_containment,
    "op11_shallot_clusters": clustering.op11_shallot_clusters,
    "op12_induced_suffix_dedup": repeats.op12_induced_suffix_dedup,
    "op13_block_rotation": middle.op13_block_rotation,
}

ORACLES: dict[str, str] = {
    "op1_loser_tree_warc": warc.OP1_SQL,
    "op2_fast_similarity": neardup.OP2_SQL,
    "op10_minhash_containment": decontaminate.OP10_SQL,
    "op11_shallot_clusters": clustering.OP11_SQL,
    "op13_block_rotation": middle.OP13_SQL,
}
