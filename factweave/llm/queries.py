"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from factweave.llm import bitslice_rank, exact_dedup, language_model, line_dedup, mixing, quality, sentencepiece_codec, simhash, spelling, toxicity, url_rules, vantage_search, vector_dedup

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op2_url_rules": url_rules.op2_url_rules,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_language_model": language_model.op6_language_model,
    "op9_simhash": simhash.op9_simhash,
    "op8_quality": quality.op8_quality,
    "op3_vector_dedup": vector_dedup.op3_vector_dedup,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op10_mix": mixing.op10_mix,
    "op11_spelling": spelling.op11_spelling,
    "op12_vantage_search": vantage_search.op12_vantage_search,
    "op13_bitslice_rank": bitslice_rank.op13_bitslice_rank,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op13_bitslice_rank": bitslice_rank.SQL,
}
