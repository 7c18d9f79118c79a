"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, fingerprint, jaccard, lm, media, negatives, packing, periodic, pipeline, quality, secrets, substrings, tokens, urls


def queries() -> dict:
    return {
        "op1_ngram_jaccard": jaccard.query,
        "op2_media_columns": media.query,
        "op3_packing": packing.query,
        "op4_quality": quality.query,
        "op5_secrets": secrets.query,
        "op6_lm_scoring": lm.query,
        "op7_token_counts": tokens.query,
        "op8_url_filter": urls.query,
        "op9_substring_dedup": substrings.query,
        "op10_decontamination": decontam.query,
        "op11_hard_negatives": negatives.query,
        "op12_periodic_runs": periodic.query,
        "op13_fingerprints": fingerprint.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": jaccard.ORACLE,
        "op2_media_columns": media.ORACLE,
        "op5_secrets": secrets.ORACLE,
        "op9_substring_dedup": substrings.ORACLE,
        "op11_hard_negatives": negatives.ORACLE,
        "op12_periodic_runs": periodic.ORACLE,
        "op13_fingerprints": fingerprint.ORACLE,
    }
