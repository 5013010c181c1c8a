"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm import bpe, embedding_dedup, jaccard_join, mixing, pii, prefix_trie, quality, secrets, spelling, suffix_dedup, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_bpe": bpe.op3_bpe,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_topk": topk.op5_topk,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_quality": quality.op7_quality,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_pii": pii.op11_pii,
        "op12_spelling": spelling.op12_spelling,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.op2_sql(),
        "op4_embedding_dedup": embedding_dedup.op4_sql(),
        "op5_topk": topk.op5_sql(),
        "op9_mix_sources": mixing.mixing_sql(),
        "op12_spelling": spelling.op12_sql(),
        "op13_prefix_trie": prefix_trie.op13_sql(),
    }
