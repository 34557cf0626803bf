"""Every registered query and its SQL, by name."""

from __future__ import annotations

import importlib

#: Modules of ``recallgrid.plans`` with QUERIES and ORACLES.
MODULES: list[str] = ["filters", "joins", "stats", "windows", "search", "text", "ingest"]


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"recallgrid.plans.{name}"), kind)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
