"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from slipway.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    line_dedup,
    quality,
    search,
    secrets,
    sharding,
    simhash,
    spelling,
    substring_dedup,
)
from slipway.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_html_text": html_text.op2_html_text,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_sharding": sharding.op6_sharding,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": quality.op9_quality,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_search": search.op11_search,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_search": search.OP11_SQL,
    "op12_substring_dedup": substring_dedup.OP12_SQL,
}
