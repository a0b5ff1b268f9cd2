"""Registered queries, grouped by subject."""

from importlib import import_module

_MODULES = ("data", "features", "evaluation", "monitoring", "models")


def load_all() -> None:
    for name in _MODULES:
        import_module(f"tablewright.catalog.{name}")
