"""All registered queries and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ["stacking", "colour", "calibration", "screening", "sky_background", "placing", "matching", "measuring", "records", "pieces", "sequences"]


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
