"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in ("prep", "corpus", "vocab", "vectors", "runs", "misc"):
    _m = importlib.import_module(f"tarnwork.plans.{_name}")
    QUERIES |= _m.Q
    ORACLES |= _m.O
