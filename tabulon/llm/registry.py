"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from tabulon.llm import (
    byte_language,
    gapped_toxicity,
    hilbert_shards,
    kneser_ney_quality,
    one_bit_neighbours,
    piece_codec,
    prefix_jaccard,
    quality_rules,
    raked_mix,
    warc_chunks,
)

QUERIES = {
    "op1_hilbert_shards": hilbert_shards.op1_hilbert_shards,
    "op2_raked_mix": raked_mix.op2_raked_mix,
    "op3_byte_language": byte_language.op3_byte_language,
    "op4_warc_chunks": warc_chunks.op4_warc_chunks,
    "op5_prefix_jaccard": prefix_jaccard.op5_prefix_jaccard,
    "op6_gapped_toxicity": gapped_toxicity.op6_gapped_toxicity,
    "op7_kneser_ney_quality": kneser_ney_quality.op7_kneser_ney_quality,
    "op8_one_bit_neighbours": one_bit_neighbours.op8_one_bit_neighbours,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES: dict[str, str] = {
    "op2_raked_mix": raked_mix.ORACLE,
    "op4_warc_chunks": warc_chunks.ORACLE,
    "op5_prefix_jaccard": prefix_jaccard.ORACLE,
    "op8_one_bit_neighbours": one_bit_neighbours.ORACLE,
}
