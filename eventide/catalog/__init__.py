"""Registered queries: a Spark callable and the SQL it must equal, side by side."""
from __future__ import annotations

from importlib import import_module

from eventide.catalog.registry import ORACLES, QUERIES

MODULES = ("neighborhoods", "encodings", "evaluation", "tables", "modelling")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        import_module(f"eventide.catalog.{m}")
    return dict(QUERIES), dict(ORACLES)
