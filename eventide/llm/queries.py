"""The queries of this package: one per operator over its whole table."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("bpe_queries", "mixing_queries", "simhash_queries", "secret_queries", "vector_queries", "language_queries", "repeat_queries", "lm_queries",
           "fill_middle_queries", "exact_queries", "spelling_queries")


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}
    for m in MODULES:
        module = import_module(f"eventide.llm.{m}")
        queries |= module.QUERIES
        oracles |= getattr(module, "ORACLES", {})
    return queries, oracles
