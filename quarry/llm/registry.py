"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_extract, line_dedup, near_dedup, quality, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_chat_format": chat.query,
    "op3_html_extract": html_extract.query,
    "op4_order_minhash": near_dedup.query,
    "op5_url_filter": url_filter.query,
    "op6_line_dedup": line_dedup.query,
    "op7_decontaminate": decontaminate.query,
    "op8_byte_bpe": bpe.query,
    "op9_quality": quality.query,
    "op10_toxicity": toxicity.query,
}

ORACLE_SQL: dict[str, str] = {"op5_url_filter": url_filter.SQL, "op7_decontaminate": decontaminate.SQL}
