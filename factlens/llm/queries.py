"""One query for each operator of this subpackage, over its whole table, and SQL where there is a form; op2 is registered once more for what SQL can count."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, html_text, language_id, line_dedup, lm_scoring, mixing, ngram_join, token_counts

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_token_counts": token_counts.op2,
    "token_rollup_patterns": token_counts.rollup,
    "op3_chat_formatting": chat_format.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_lm_scoring": lm_scoring.op5,
    "op6_html_extraction": html_text.op6,
    "op7_source_mixing": mixing.op7,
    "op8_benchmark_decontamination": decontaminate.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_language_id": language_id.op10,
}

ORACLE = {
    "token_rollup_patterns": token_counts.ROLLUP_SQL,
    "op3_chat_formatting": chat_format.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
