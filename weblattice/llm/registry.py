"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import weblattice.llm as here


def _modules():
    for m in pkgutil.iter_modules(here.__path__):
        if m.name.startswith("p") and m.name[1].isdigit():
            yield importlib.import_module(f"weblattice.llm.{m.name}")


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _modules() for k, q in getattr(m, "SQL", {}).items()}
