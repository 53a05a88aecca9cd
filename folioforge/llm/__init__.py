"""Operators for training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

#: Modules and the queries each has.
MODULES = {
    "p1_reading_level": ["p1_found", "p1_levels"],
    "p2_ocr": ["p2_found", "p2_paragraphs"],
    "p3_format_dups": ["p3_found", "p3_entries"],
    "p4_near_dups": ["p4_found", "p4_groups"],
    "p5_token_budget": ["p5_tokens", "p5_token_budget"],
    "p6_lookalike": ["p6_found", "p6_text", "p6_left"],
    "p7_encode": ["p7_ids"],
    "p8_packing": ["p8_containers", "p8_fill"],
    "p9_truncation": ["p9_found", "p9_sources"],
}


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    return {q: getattr(importlib.import_module(f"{__name__}.{m}"), q) for m, names in MODULES.items() for q in names}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__name__}.{m}"), "SQL", {}).items()}
