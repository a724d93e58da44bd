"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from corpusloom.llm import bpe, crf_language, hash_recount, jaccard_join, order_minhash, ordinal, positional_index, pu_quality, quote_links, shared_search, site_style_tree, url_reputation, warc

QUERIES = {
    "op1_decontamination": positional_index.op1_decontamination,
    "op2_quality": pu_quality.op2_quality,
    "op3_quote_links": quote_links.op3_quote_links,
    "op4_language": crf_language.op4_language,
    "op5_main_text": site_style_tree.op5_main_text,
    "op6_fingerprints": order_minhash.op6_fingerprints,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_toxicity": ordinal.op8_toxicity,
    "op9_warc": warc.op9_warc,
    "op10_bpe": bpe.op10_bpe,
    "op11_source_divergence": hash_recount.op11_source_divergence,
    "op12_url_filter": url_reputation.op12_url_filter,
    "op13_ranked_search": shared_search.op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": positional_index.OP1_SQL,
    "op3_quote_links": quote_links.OP3_SQL,
    "op5_main_text": site_style_tree.OP5_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_source_divergence": hash_recount.OP11_SQL,
    "op12_url_filter": url_reputation.OP12_SQL,
    "op13_ranked_search": shared_search.OP13_SQL,
}
