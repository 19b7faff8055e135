"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, langid, linededup, mixing, negatives, quality, resampling, simhash, suffix, tokencount, tokenfiles, vectors, whitening

QUERIES = {
    "op1_embedding_near_dedup": vectors.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_line_dedup": linededup.op4,
    "op5_token_counts": tokencount.op5,
    "op6_quality_rules": quality.op6,
    "op7_quality_classifier": resampling.op7,
    "op8_suffix_array_dedup": suffix.op8,
    "op9_mixing": mixing.op9,
    "op10_language_id": langid.op10,
    "op11_embedding_whitening": whitening.op11,
    "op12_token_files": tokenfiles.op12,
    "op13_hard_negatives": negatives.op13,
}
SQL = {
    "op4_line_dedup": linededup.OP4_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
