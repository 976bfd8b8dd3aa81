"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chunk_dedup, decontaminate, exact_dedup, hard_negatives, language_id, license_scan, line_dedup, mixing, near_dedup, ngram_lm, quality_crf, suffix_dedup, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op2_near_dedup_links": near_dedup.op2_near_dedup_links,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_chunk_dedup": chunk_dedup.op5_chunk_dedup,
    "op6_ngram_lm": ngram_lm.op6_ngram_lm,
    "op7_quality_crf": quality_crf.op7_quality_crf,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language_id": language_id.op9_language_id,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_whitening": whitening.op12_whitening,
    "op13_license_scan": license_scan.op13_license_scan,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_near_dedup": near_dedup.ORACLE,
    "op4_mix_sources": mixing.oracle(),
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_license_scan": license_scan.ORACLE,
}
