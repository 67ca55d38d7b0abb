"""The registered queries of this subpackage and their SQL."""

from photark.llm import hard_negatives, language_id, line_dedup, media_chunks, mixing, packing, simhash, spelling, suffix_dedup, token_store, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_store": token_store.op3_token_store,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_media_chunks": media_chunks.op7_media_chunks,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_topk": topk.op10_topk,
    "op11_spelling": spelling.op11_spelling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_language_id": language_id.op13_language_id,
}

SQL = {"op8_mixing": mixing.OP8_SQL, "op10_topk": topk.OP10_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
