"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprint, language, mixing, near_dedup, reshard, secrets, substrings, token_counts, toxicity

QUERIES = [
    near_dedup.op1_chosen_path_near_dedup,
    substrings.op2_columnwise_substrings,
    fingerprint.op3_improbable_features,
    secrets.op4_multipart_secrets,
    reshard.op5_min_cost_flow_sharding,
    decontaminate.op6_wu_manber_decontamination,
    language.op7_rank_order_language,
    token_counts.op8_pretoken_counts,
    mixing.op9_raked_mixture,
    toxicity.op10_crf_toxicity,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chosen_path_near_dedup": near_dedup.SQL,
        "op4_multipart_secrets": secrets.SQL,
        "op6_wu_manber_decontamination": decontaminate.SQL,
        "op9_raked_mixture": mixing.SQL,
    }
