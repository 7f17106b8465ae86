"""Every operator as a runnable query over the benchmark tables."""

from __future__ import annotations

import importlib

_MODULES = [
    "scan", "scalar", "quality", "joins", "aggregates", "channel_windows",
    "object_windows", "ranking", "evaluation", "models", "releases", "streams",
]


def load():
    """(queries, oracles) of all families."""
    from watchgrid.catalogue import registry

    for name in _MODULES:
        importlib.import_module(f"watchgrid.catalogue.{name}")
    return registry.QUERIES, registry.ORACLES
