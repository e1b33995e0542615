"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from millrace.llm import decontamination, forest, hamming, language_id, periodic, pieces, quantizer, separators, sharding, simhash, substrings, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_topk_search": hamming.op4_topk_search,
    "op5_sharding": sharding.op5_sharding,
    "op6_warc": warc.op6_warc,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": separators.op9_token_counts,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_vector_codes": quantizer.op12_vector_codes,
    "op13_nearest_neighbours": forest.op13_nearest_neighbours,
}
ORACLES = {
    "op4_topk_search": hamming.ORACLE,
    "op2_url_filters": url_filter.ORACLE,
    "op6_warc": warc.ORACLE,
    "op10_substring_dedup": substrings.ORACLE,
    "op12_vector_codes": quantizer.ORACLE,
}
