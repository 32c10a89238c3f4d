"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from lodestone.llm import (
    cost_packing, curriculum_mix, decontaminate, extendible_shards, imatch, importance_resampling, license_scan, ngram_jaccard, quality_classifier, secret_scan, url_reputation,
    warc, whitening,
)

QUERIES = {
    "op1_index_merge": warc.op1_index_merge,
    "op2_extendible_shards": extendible_shards.op2_extendible_shards,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_ngram_jaccard": ngram_jaccard.op7_ngram_jaccard,
    "op8_curriculum_mix": curriculum_mix.op8_curriculum_mix,
    "op9_imatch": imatch.op9_imatch,
    "op10_url_reputation": url_reputation.op10_url_reputation,
    "op11_importance_resampling": importance_resampling.op11_importance_resampling,
    "op12_whitening": whitening.op12_whitening,
    "op13_cost_packing": cost_packing.op13_cost_packing,
}
ORACLES = {
    "op1_index_merge": warc.SQL,
    "op2_extendible_shards": extendible_shards.SQL,
    "op5_license_scan": license_scan.SQL,
    "op8_curriculum_mix": curriculum_mix.SQL,
    "op10_url_reputation": url_reputation.SQL,
    "op11_importance_resampling": importance_resampling.SQL,
}
