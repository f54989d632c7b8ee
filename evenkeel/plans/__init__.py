"""Named queries over the given tables, each with its plain-SQL twin."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module once, so that it registers its queries."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{info.name}")
