"""Registered queries, their SQL oracles and the views both run on."""

import importlib

MODULES = ("screening", "reports", "ingest", "published")


def load_all() -> None:
    """Import every query module once, so that all queries are registered."""
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
