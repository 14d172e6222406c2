"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["bpe", "packing", "simhash", "language", "toxicity", "sharding", "linededup", "fingerprint", "neardup", "html"]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"quillmill.llm.{module}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
