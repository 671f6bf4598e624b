"""Registered queries of the subpackage and, where SQL can say it, their oracle SQL."""

from __future__ import annotations

from omiclattice.llm import concat_packing, decontaminate, hard_negatives, lm_scores, near_join, packing, pii, quality, ranked_search, token_files, topk, toxicity, wordpiece

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_token_counts": wordpiece.query,
    "op3_token_files": token_files.query,
    "op4_toxicity": toxicity.query,
    "op5_pii": pii.query,
    "op6_near_join": near_join.query,
    "op7_quality": quality.query,
    "op8_top_k": topk.query,
    "op9_lm_scores": lm_scores.query,
    "op10_best_fit_packing": packing.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_ranked_search": ranked_search.query,
    "op13_concat_packing": concat_packing.query,
}
ORACLES = {"op8_top_k": topk.SQL, "op9_lm_scores": lm_scores.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_ranked_search": ranked_search.SQL}
