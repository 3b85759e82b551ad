"""Registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ["ingest", "faults", "text", "places", "tables", "maps", "terrain"]


def load():
    """All queries and their SQL, by name."""
    from gridterrain.catalogue.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"gridterrain.catalogue.{name}")
    return QUERIES, ORACLES
