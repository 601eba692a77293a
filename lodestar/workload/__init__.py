"""Every operator run over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

from .base import REGISTRY

MODULES = ("relational", "ingestion", "chunks", "vectors", "ranking", "fusion", "graphs", "logs", "hooks")


def load() -> dict:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
