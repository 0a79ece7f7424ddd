"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import language, line_dedup, mixing, mpeg, near_dedup, packing, rans, sharding, topk, toxicity

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_mpeg_audio": mpeg.op2_mpeg_audio,
    "op3_rans_tokens": rans.op3_rans_tokens,
    "op4_topk": topk.op4_topk,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op4_topk": topk.SQL,
    "op7_sharding": sharding.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
