"""Registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["packing", "urls", "decontaminate", "search", "suffixes", "jaccard", "toxicity", "language", "pages", "quality",
           "languages", "phrases", "periodic"]


def queries() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f".{name}", __package__).QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f".{name}", __package__).ORACLES)
    return out
