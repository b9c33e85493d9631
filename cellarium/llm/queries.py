"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

from cellarium.llm import bpe, embedding_dedup, exact_dedup, lm, minhash, neighbours, packing, phrases, quality, spelling, token_files, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_packing": packing.op3_packing,
    "op4_bpe_encoding": bpe.op4_bpe_encoding,
    "op5_token_files": token_files.op5_token_files,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_warc_derivatives": warc.op9_warc_derivatives,
    "op10_minhash_dedup": minhash.op10_minhash_dedup,
    "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}

ORACLE_SQL = {
    "op6_embedding_dedup": embedding_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_warc_derivatives": warc.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
