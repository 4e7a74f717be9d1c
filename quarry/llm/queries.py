"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm import licenses, lm, media, mixing, quality, secrets, sentencepieces, sharding, simhash, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_mixing": mixing.op2_mixing,
        "op3_licenses": licenses.op3_licenses,
        "op4_sharding": sharding.op4_sharding,
        "op5_sentencepiece": sentencepieces.op5_sentencepiece,
        "op6_lm": lm.op6_lm,
        "op7_media": media.op7_media,
        "op8_quality": quality.op8_quality,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.ORACLE,
        "op4_sharding": sharding.ORACLE,
        "op8_quality": quality.oracle(),
    }
