"""Runnable bindings of every operator to the Parquet tables, each with its SQL definition."""

from importlib import import_module

MODULES = ["core", "expressions", "relational", "opportunities", "reports"]


def load():
    """All registered queries by key."""
    from partner_analytics.catalog.registry import ENTRIES

    for name in MODULES:
        import_module(f"partner_analytics.catalog.{name}")
    return ENTRIES
