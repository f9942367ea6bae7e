"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import exact, fingerprints, hamming, jaccard, language, licenses, lm, middle, mixing, packing, quality, substrings, variants
from graphloom.session import table

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_fingerprints": lambda spark, sf_dir: fingerprints.op1_fingerprints(table(spark, sf_dir, "documents")),
    "op2_license_scan": lambda spark, sf_dir: licenses.op2_license_scan(table(spark, sf_dir, "documents")),
    "op6_topk_search": lambda spark, sf_dir: hamming.op6_topk_search(table(spark, sf_dir, "embeddings")),
    "op9_jaccard_join": lambda spark, sf_dir: jaccard.op9_jaccard_join(table(spark, sf_dir, "documents")),
    "op3_lm_score": lambda spark, sf_dir: lm.op3_lm_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_language_id": lambda spark, sf_dir: language.op7_language_id(table(spark, sf_dir, "documents")),
    "op8_quality_classifier": lambda spark, sf_dir: quality.op8_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_pack": lambda spark, sf_dir: packing.op10_pack(table(spark, sf_dir, "documents")),
    "op4_substring_dedup": lambda spark, sf_dir: substrings.op4_substring_dedup(table(spark, sf_dir, "documents")),
    "op5_mix_sources": lambda spark, sf_dir: mixing.op5_mix_sources(table(spark, sf_dir, "documents")),
    "op11_fill_in_middle": lambda spark, sf_dir: middle.op11_fill_in_middle(table(spark, sf_dir, "documents")),
    "op12_spelling_variants": lambda spark, sf_dir: variants.op12_spelling_variants(table(spark, sf_dir, "documents")),
    "op13_exact_dedup": lambda spark, sf_dir: exact.op13_exact_dedup(table(spark, sf_dir, "documents")),
}

ORACLES = {
    "op2_license_scan": licenses.ORACLE,
    "op6_topk_search": hamming.ORACLE,
    "op3_lm_score": lm.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op11_fill_in_middle": middle.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_exact_dedup": exact.ORACLE,
}
