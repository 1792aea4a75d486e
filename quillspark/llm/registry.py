"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontaminate, licenses, media, mixing, neardup, quality, repeats, tokens, urls


def queries() -> dict:
    return {
        "op1_pareto_mix": mixing.op1_pareto_mix,
        "op2_winnowed_alignment": licenses.op2_winnowed_alignment,
        "op3_bucket_refinement": repeats.op3_bucket_refinement,
        "op4_local_descriptors": media.op4_local_descriptors,
        "op5_host_reputation": urls.op5_host_reputation,
        "op6_snapshot_collapse": chat.op6_snapshot_collapse,
        "op7_kneser_ney": quality.op7_kneser_ney,
        "op8_block_max_wand": decontaminate.op8_block_max_wand,
        "op9_context_mixing_blocks": tokens.op9_context_mixing_blocks,
        "op10_lsh_forest": neardup.op10_lsh_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": mixing.OP1_SQL,
        "op5_host_reputation": urls.OP5_SQL,
        "op6_snapshot_collapse": chat.OP6_SQL,
        "op10_lsh_forest": neardup.OP10_SQL,
    }
