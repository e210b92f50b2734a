"""The registered queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from gleanery.llm import bpe_table, decontamination, exact_dedup, hard_negatives, line_dedup, merkle, quality, sharding, simhash, substring_dedup, token_output, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_bit_planes": token_output.op3_bit_planes,
    "op4_bpe_words": bpe_table.op4_bpe_words,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle": merkle.op11_merkle,
    "op12_radix_negatives": hard_negatives.op12_radix_negatives,
    "op13_toxicity": toxicity.op13_toxicity,
}

#: op3 and op4 have none: SQL has no byte-pair merges.
ORACLES = {
    "op5_decontamination": decontamination.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_sharding": sharding.op10_sql(),
    "op11_merkle": merkle.OP11_SQL,
    "op12_radix_negatives": hard_negatives.OP12_SQL,
}
