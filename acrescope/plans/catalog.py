"""Registry of named queries, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from acrescope.plans.oracle_views import VIEWS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\bfx_[a-z0-9_]+\b")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Inline the fixture views a statement mentions as common table expressions."""
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in names)
    return f"WITH {ctes}\nSELECT * FROM (\n{sql.strip()}\n) AS result"


def query(name: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame`` under a name; fx are the bound tables."""

    def register(fn):
        def run(spark, sf_dir):
            from acrescope.plans.fixtures import Fixtures

            return fn(Fixtures(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
