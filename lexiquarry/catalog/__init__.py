"""Named queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("search", "chunking", "text", "tables", "fields", "answers", "metrics", "storage")


def load_all():
    """All queries and all SQL equivalents by name."""
    from . import registry

    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
