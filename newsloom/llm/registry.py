"""Queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from newsloom.llm import compression, covertree, filteraudit, language, licenses, linededup, mixing, neardup, packing, tokencount, toxicity, vectorcodes, vectordup

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_embedding_neardup": vectordup.op2_embedding_neardup,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_top_products": covertree.op7_top_products,
    "op8_language": language.op8_language,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash": neardup.op10_minhash,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_quality": compression.op13_quality,
}

ORACLES = {
    "op2_embedding_neardup": vectordup.SQL,
    "op3_mixing": mixing.SQL,
    "op4_line_dedup": linededup.SQL,
    "op7_top_products": covertree.SQL,
    "op11_filter_audit": filteraudit.SQL,
    "op12_vector_codes": vectorcodes.SQL,
}
