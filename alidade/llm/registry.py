"""The llm queries and their SQL, by name."""

from __future__ import annotations

from alidade.llm import bpe, filters, fingerprints, licences, line_dedup, mixing, ngram_join, pieces, quality, ranked, secrets, sharding, suffixes

MODULES = {
    "op1_licence_scan": licences,
    "op2_proportional_sharding": sharding,
    "op3_secret_scan": secrets,
    "op4_token_counts": bpe,
    "op5_line_dedup": line_dedup,
    "op6_ngram_jaccard_join": ngram_join,
    "op7_sentencepiece": pieces,
    "op8_fingerprints": fingerprints,
    "op9_quality_rules": quality,
    "op10_source_mixing": mixing,
    "op11_suffix_dedup": suffixes,
    "op12_ranked_search": ranked,
    "op13_filter_audit": filters,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
