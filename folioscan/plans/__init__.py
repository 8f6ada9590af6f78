"""Registered queries. Importing `load` fills the catalog."""

from __future__ import annotations

import importlib

from .registry import CATALOG, Query

MODULES = ("orders", "retrieval", "corpus", "texts", "chunks", "links", "activity", "incremental", "files")


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return CATALOG
