"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from mentionlake.llm import additive_index, bpe, conversation_repair, jaccard_join, kd_search, license_scan, line_dedup, lm_score, mixing, periodic_runs, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_additive_index": additive_index.op4_additive_index,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_kd_search": kd_search.op6_kd_search,
    "op7_bpe": bpe.op7_bpe,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLES = {"op8_url_filter": url_filter.ORACLE, "op9_mixing": mixing.ORACLE, "op6_kd_search": kd_search.ORACLE}
