"""Queries op1 to op10 and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import decontamination, language, media, mixing, page_text, personal_data, quality, sharding, simhash, toxicity

QUERIES = {
    "op1_quality": quality.query,
    "op2_language": language.query,
    "op3_personal_data": personal_data.query,
    "op4_toxicity": toxicity.query,
    "op5_page_text": page_text.query,
    "op6_decontamination": decontamination.query,
    "op7_mixing": mixing.query,
    "op8_simhash": simhash.query,
    "op9_sharding": sharding.query,
    "op10_media": media.query,
}

ORACLES = {
    "op6_decontamination": decontamination.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_sharding": sharding.ORACLE,
}
