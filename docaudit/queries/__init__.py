"""Queries over the driver tables, one per operator."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("sources", "blocks", "extraction", "fields", "groups", "rules", "history", "catalogue", "views")


def load():
    """Import every query module; returns ``(queries, oracle sql)``."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
