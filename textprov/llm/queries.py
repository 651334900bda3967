"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bloom_lm, chat, exact_dedup, importance, minhash, mixing, packing, quality_rules, token_counts, token_store

QUERIES = {
    "op6_importance_resampling": importance.op6,
    "op9_mixing": mixing.op9,
    "op5_chat_format": chat.op5,
    "op3_lm_scoring": bloom_lm.op3,
    "op2_near_duplicates": minhash.op2,
    "op4_quality_rules": quality_rules.op4,
    "op7_best_fit_packing": packing.op7,
    "op1_token_store": token_store.op1,
    "op8_exact_dedup": exact_dedup.op8,
    "op10_token_counts": token_counts.op10,
}
SQL = {
    "op2_near_duplicates": minhash.OP2_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
