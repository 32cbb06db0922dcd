"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("flow_queries", "table_queries", "detector_queries", "alert_queries", "detection_queries")


def load_all():
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
