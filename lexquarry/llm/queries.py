"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from lexquarry.llm import jaccard_join, media, mixing, packing, quality, secrets, substring_dedup, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_quality_rules": quality.query,
        "op3_jaccard_join": jaccard_join.query,
        "op4_media_columns": media.query,
        "op5_secret_scans": secrets.query,
        "op6_warc": warc.query,
        "op7_token_counts": token_counts.query,
        "op8_mixing": mixing.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join.ORACLE, "op6_warc": warc.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE}
