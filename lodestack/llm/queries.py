"""Queries of the subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestack.llm import byte_bpe, decontaminate, exact_dedup, language_id, license_scan, ngram_join, periodic_runs, pii, quality, ranked_search, secret_scan, sharding, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_pii": pii.op5_pii,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality": quality.op7_quality,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_license_scan": license_scan.op13_license_scan,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_license_scan": license_scan.SQL,
}
