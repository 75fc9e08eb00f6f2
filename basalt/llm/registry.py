"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, embed_dedup, line_dedup, minhash, mixing, pii, quality, substring, token_count


def queries() -> dict:
    return {
        "op1_token_counts": token_count.query,
        "op2_embedding_near_dedup": embed_dedup.query,
        "op3_source_mixing": mixing.query,
        "op4_line_dedup": line_dedup.query,
        "op5_byte_bpe": bpe.query,
        "op6_minhash_near_dedup": minhash.query,
        "op7_chat_formatting": chat.query,
        "op8_substring_dedup": substring.query,
        "op9_quality_rules": quality.query,
        "op10_pii_surrogates": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_near_dedup": embed_dedup.ORACLE,
        "op6_minhash_near_dedup": minhash.ORACLE,
        "op7_chat_formatting": chat.ORACLE,
        "op8_substring_dedup": substring.ORACLE,
    }
