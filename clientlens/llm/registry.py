"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from clientlens.llm import (
    ann_tree, brown_lm, decontaminate, hard_negatives, html_extract, importance, jaccard_join, mixing, quality, simhash, substring_dedup,
    token_counts, url_filter,
)

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality": quality.op3_quality,
    "op4_brown_lm": brown_lm.op4_brown_lm,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op8_mixing": mixing.op8_mixing,
    "op7_ann_tree": ann_tree.op7_ann_tree,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_simhash": simhash.op10_simhash,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_importance": importance.op12_importance,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op11_jaccard_join": jaccard_join.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
