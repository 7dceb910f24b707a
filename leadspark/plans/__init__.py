"""Registered queries over the driver tables, each beside its SQL twin."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("linking", "utm", "costs", "scoring", "metrics", "profiling", "model", "streams", "intake", "persons", "loading", "sketching")


def load_all():
    """``(queries, oracle)`` of every family."""
    from . import registry

    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
