"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, divergence, jaccard, minhash, mixing, neighbours, packing, quality, scoring, secrets, suffix, tokens, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_token_shards": tokens.op5_token_shards,
    "op6_quality": quality.op6_quality,
    "op7_secrets": secrets.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_lm_scores": scoring.op10_lm_scores,
    "op11_divergence": divergence.op11_divergence,
    "op12_collocations": collocations.op12_collocations,
    "op13_minhash": minhash.op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix.ORACLE_SQL,
    "op4_jaccard_join": jaccard.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_minhash": minhash.ORACLE_SQL,
}
