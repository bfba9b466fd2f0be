"""Registered queries, by group."""

from __future__ import annotations

from importlib import import_module

from parlance.plans.registry import CHECKS, QUERIES, Query

GROUPS = ["reading", "joins", "aggregates", "scalars", "canonical", "scans", "identity", "upkeep", "quality", "live"]


def _load() -> None:
    for group in GROUPS:
        import_module(f"parlance.plans.{group}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def check_sql() -> dict[str, str]:
    _load()
    return dict(CHECKS)
