"""Queries of this subpackage, by name."""

from . import cosine_dedup, decontaminate, interleave, language_id, line_dedup, minhash_hamming, preferences, quality, sentencepieces, token_shards


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_minhash_dedup": minhash_hamming.op2_minhash_dedup,
        "op3_token_shards": token_shards.op3_token_shards,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_quality": quality.op5_quality,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_language_id": language_id.op7_language_id,
        "op8_preferences": preferences.op8_preferences,
        "op9_interleave": interleave.op9_interleave,
        "op10_cosine_dedup": cosine_dedup.op10_cosine_dedup,
    }


def oracle_sql():
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op8_preferences": preferences.OP8_SQL}
