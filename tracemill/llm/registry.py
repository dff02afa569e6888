"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, exact, html, lines, near, packing, quality, urls, warc

QUERIES = {
    "op1_html_extract": html.query,
    "op2_quality_rules": quality.query,
    "op3_exact_dedup": exact.query,
    "op4_warc_bundles": warc.query,
    "op5_chat_format": chat.query,
    "op6_best_fit_packing": packing.query,
    "op7_line_dedup": lines.query,
    "op8_jaccard_join": near.query,
    "op9_url_filter": urls.query,
    "op10_bpe": bpe.query,
}
ORACLES = {
    "op2_quality_rules": quality.SQL,
    "op3_exact_dedup": exact.SQL,
    "op5_chat_format": chat.SQL,
    "op7_line_dedup": lines.SQL,
}
