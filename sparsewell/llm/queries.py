"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_warc": "warc",
    "op2_line_dedup": "linededup",
    "op3_token_file": "tokenfile",
    "op4_ngram_jaccard": "ngramjoin",
    "op5_quality_rules": "quality",
    "op6_decontamination": "decontam",
    "op7_token_counts": "tokencount",
    "op8_mixing": "mixing",
    "op9_language_id": "langid",
    "op10_license_scan": "licenses",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
