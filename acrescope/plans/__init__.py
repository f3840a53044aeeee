"""Bound queries: fixtures, catalog and DuckDB equivalents."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """(queries, oracles) with every ``q_*`` module imported."""
    from acrescope.plans import catalog

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return catalog.QUERIES, catalog.ORACLES
