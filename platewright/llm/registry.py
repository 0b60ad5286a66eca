"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from platewright.llm import decontaminate, html_text, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity, warc

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_decontaminate": decontaminate.query,
    "op3_html_text": html_text.query,
    "op4_line_dedup": line_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_packing": packing.query,
    "op7_ngram_join": ngram_join.query,
    "op8_sharding": sharding.query,
    "op9_warc": warc.query,
    "op10_quality_rules": quality_rules.query,
}
ORACLE = {
    "op7_ngram_join": ngram_join.SQL,
    "op9_warc": warc.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
