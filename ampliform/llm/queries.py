"""The queries that this subpackage registers, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, importance, jaccard_join, licenses, mixing, negatives, page_text, repeats, sharding, token_counts, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_repeats": repeats.op2_repeats,
    "op3_sharding": sharding.op3_sharding,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_importance": importance.op11_importance,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_page_text": page_text.op13_page_text,
}

ORACLE = exact_dedup.ORACLE | embedding_dedup.ORACLE | jaccard_join.ORACLE | importance.ORACLE | negatives.ORACLE
