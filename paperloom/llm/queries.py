"""The queries of the training-data operators and their SQL, gathered from their modules."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_licenses",
    "op2_token_ids",
    "op3_mixing",
    "op4_html",
    "op5_toxicity",
    "op6_near_dedup",
    "op7_warc",
    "op8_quality",
    "op9_substrings",
    "op10_decontamination",
    "op11_collocations",
    "op12_alignment",
    "op13_jaccard_join",
)


def _modules():
    return [import_module(f".{m}", __package__) for m in MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
