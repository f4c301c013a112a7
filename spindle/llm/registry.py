"""Queries of this subpackage for the driver, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, chat, importance, language_id, mixing, near_dedup, neighbours, pii, quality, sharding, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_pii": pii.op2_pii,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_language_id": language_id.op7_language_id,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_mixing": mixing.op10_mixing,
    "op11_chat": chat.op11_chat,
    "op12_importance": importance.op12_importance,
    "op13_vector_codes": vector_codes.op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op10_mixing": mixing.OP10_SQL, "op11_chat": chat.OP11_SQL, "op12_importance": importance.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
