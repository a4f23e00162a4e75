"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from sluice.llm import decontam, html, langid, merkle, mixing, neardup, pii, quality, tokens, urls

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_tokens": tokens.op4_tokens,
    "op5_simhash": neardup.op5_simhash,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_urls": urls.op7_urls,
    "op8_mix": mixing.op8_mix,
    "op9_html": html.op9_html,
    "op10_merkle": merkle.op10_merkle,
}

ORACLE_SQL = {"op8_mix": mixing.ORACLE_SQL}
