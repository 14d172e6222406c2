"""Settings in layers: later files and values go before earlier ones, key by key.

A file holds one JSON object; comments and commas before a closing bracket are allowed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping

_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
_LAST_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


def without_comments(text: str) -> str:
    """Plain JSON."""
    plain = _PIECES.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return _LAST_COMMA.sub(lambda m: m[1] or "", plain)


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.loads(without_comments(f.read()))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: no object")
    return found


def layered(defaults: Mapping, files: Iterable[str | None], given: Mapping | None = None, required: Iterable[str] = ()) -> dict:
    """defaults, then each file that is there, then the given values that are not None.
    Files in `required` must be there; keys that the defaults don't have are errors."""
    out, required = dict(defaults), set(required)
    for path in files:
        if path is None or path not in required and not os.path.exists(path):
            continue
        out |= read(path)
    out |= {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := set(out) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return out
