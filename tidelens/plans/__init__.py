"""Registered queries: each module binds operators to the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every query module so that the registry is complete."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("on_"):
            importlib.import_module(f"{__name__}.{info.name}")
