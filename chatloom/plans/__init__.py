"""Complete builds: from raw tables to chat datasets, and the registered queries."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["queries_text", "queries_encode", "queries_build", "queries_vectors", "queries_io"]


def _load() -> None:
    for name in _MODULES:
        import_module(f"chatloom.plans.{name}")


def all_queries() -> dict:
    _load()
    from chatloom.plans.registry import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from chatloom.plans.registry import ORACLES

    return dict(ORACLES)
