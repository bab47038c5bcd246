"""Contract queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import archives, decontaminate, jaccard, langid, lexical, linededup, lm, merkle, mixing, quality, secrets, sharding, urls


def queries() -> dict:
    return {
        "op1_lm_scoring": lm.op1_lm_scoring,
        "op2_url_filters": urls.op2_url_filters,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_sharding": sharding.op4_sharding,
        "op5_language_id": langid.op5_language_id,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_secret_scans": secrets.op7_secret_scans,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_ranked_search": lexical.op12_ranked_search,
        "op13_warc": archives.op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": urls.ORACLE_OP2,
        "op3_line_dedup": linededup.ORACLE_OP3,
        "op9_mixing": mixing.ORACLE_OP9,
        "op10_decontamination": decontaminate.ORACLE_OP10,
        "op11_merkle_manifest": merkle.ORACLE_OP11,
        "op12_ranked_search": lexical.ORACLE_OP12,
        "op13_warc": archives.ORACLE_OP13,
    }
