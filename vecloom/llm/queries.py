"""All registered queries of this subpackage."""

from __future__ import annotations

import importlib

PARTS = ["search_answers", "clusters", "abstracts", "pieces", "neighbours", "contexts", "leaks", "sentences"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in PARTS:
    _part = importlib.import_module(f"vecloom.llm.{_name}")
    QUERIES |= _part.QUERIES
    ORACLES |= getattr(_part, "ORACLES", {})
