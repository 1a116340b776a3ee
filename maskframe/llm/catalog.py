"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, htmltext, langid, mixing, neardup, substring_dedup, suffix_dedup, tokencount, topk, warc


def queries() -> dict:
    return {
        "op1_token_counts": tokencount.op1_token_counts,
        "op2_topk": topk.op2_topk,
        "op3_language_id": langid.op3_language_id,
        "op4_html_text": htmltext.op4_html_text,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_minhash_forest": neardup.op7_minhash_forest,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """Token counts, language ID, HTML, near duplicates and substring dedup have no SQL form here; their tests use brute force or held-out rows."""
    return {"op2_topk": topk.OP2_SQL, "op6_mix_sources": mixing.OP6_SQL, "op10_warc": warc.OP10_SQL}
