"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from smeltry.llm import decontaminate, hard_negatives, html_text, jaccard_join, kd_shards, posting_lists, quality_rules, sentence_pieces, substring_dedup, token_alignment, token_counts, token_files, url_templates
from smeltry.llm.sql import SQL as _SQL

QUERIES = {
    f.__name__: f
    for f in (
        html_text.op1_html_text,
        kd_shards.op2_kd_shards,
        sentence_pieces.op3_sentence_pieces,
        quality_rules.op4_quality_rules,
        decontaminate.op5_decontaminate,
        substring_dedup.op6_substring_dedup,
        url_templates.op7_url_templates,
        token_counts.op8_token_counts,
        token_files.op9_token_files,
        jaccard_join.op10_jaccard_join,
        posting_lists.op11_posting_lists,
        hard_negatives.op12_hard_negatives,
        token_alignment.op13_token_alignment,
    )
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {k: v for k, v in (_SQL | {"pipeline": corpus_pipeline.ORACLE_SQL}).items() if v}
