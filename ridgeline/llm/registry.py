"""The queries of this subpackage, and the SQL that some of them are compared with."""

from __future__ import annotations

from ridgeline.llm import chat_format, decontaminate, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_shards": sharding.op3_shards,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_quality": quality.op9_quality,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op3_shards": sharding.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
}
