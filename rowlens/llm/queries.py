"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from rowlens.llm import decontaminate, jaccard, mixing, quotes, suffix_dedup, topk, toxicity, url_filter
from rowlens.llm.token_counts import op10_token_counts
from rowlens.llm.token_files import op4_token_files

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_top_k": topk.op3_top_k,
    "op4_token_files": op4_token_files,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_link_quotes": quotes.op8_link_quotes,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

#: op4 and op10 need a tokenizer and op7 a compressor, which SQL has not, and
#: op2 digests cut bytes; tests/llm checks them against the libraries, brute
#: force and held-out labels.
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_top_k": topk.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_jaccard_join": jaccard.ORACLE,
    "op8_link_quotes": quotes.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
}
