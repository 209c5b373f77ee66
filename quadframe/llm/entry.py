"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quadframe.llm import decontaminate, jaccard_join, packing, secret_scan, sharding, simple8b, spotsigs, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_packing": packing.op3_packing,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op9_spotsigs": spotsigs.op9_spotsigs,
    "op10_simple8b": simple8b.op10_simple8b,
}

ORACLE_SQL = {
    "op1_secret_scan": secret_scan.OP1_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
}
