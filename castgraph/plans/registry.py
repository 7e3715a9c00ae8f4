"""Every query of the core by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from castgraph.plans import forms, pages, problems, processing, quality, reading, resolving, views

FLAGSHIP = "filmography"
_MODULES = [problems, views, pages, quality, resolving, processing, reading, forms]


def queries() -> dict[str, Callable]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
