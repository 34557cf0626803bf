"""Queries and SQL of all training-data operators."""

from __future__ import annotations

import importlib

MODULES = ["fingerprints", "bpe", "packing", "simhash", "exact", "linedup", "chat", "licenses", "pii", "toxicity", "minhash", "whitening", "merkle"]


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"recallgrid.llm.{name}"), kind)
    return found


def queries() -> dict:
    import corpus_pipeline

    return _all("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return _all("ORACLES")
