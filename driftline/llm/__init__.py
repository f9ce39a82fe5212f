"""Operators of a training-data pipeline over documents, pages and a benchmark.

Nothing else in the package imports this subpackage.
"""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard, licenses, linededup, lm, quality, runs, suffixes, toxicity, warc, whitening

_QUERIES = [
    (bpe.op1_bpe, None),
    (suffixes.op2_suffix_dedup, None),
    (warc.op3_warc, warc.SQL),
    (toxicity.op4_toxicity, None),
    (jaccard.op5_jaccard_join, jaccard.SQL),
    (quality.op6_quality_rules, quality.SQL),
    (linededup.op7_line_dedup, linededup.SQL),
    (linededup.op7_single_lines, linededup.SINGLE_SQL),
    (decontaminate.op8_decontaminate, decontaminate.SQL),
    (decontaminate.op8_proximity, decontaminate.PROXIMITY_SQL),
    (lm.op9_lm_scores, lm.SQL),
    (licenses.op10_license_scan, licenses.SQL),
    (licenses.op10_license_scan_all, licenses.SQL),
    (chat.op11_chat_format, None),
    (runs.op12_periodic_runs, None),
    (whitening.op13_embedding_whitening, None),
]


def queries() -> dict:
    return {f.__name__: f for f, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _QUERIES if sql}
