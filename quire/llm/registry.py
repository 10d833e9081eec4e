"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, ann, decontaminate, language, licenses, lmscore, mixing, neardup, negatives, sharding, suffixes, toxicity, urls


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_ann": ann.op2_ann,
        "op3_url_filter": urls.op3_url_filter,
        "op4_suffix_dedup": suffixes.op4_suffix_dedup,
        "op5_language_id": language.op5_language_id,
        "op6_minhash_neardup": neardup.op6_minhash_neardup,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_lm_score": lmscore.op8_lm_score,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_alignment": alignment.op11_alignment,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": urls.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op10_license_scan": licenses.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
        "op13_sharding": sharding.ORACLE,
    }
