"""Registered queries, by family; importing a module of this package enters its queries in the catalog."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{m.name}")
