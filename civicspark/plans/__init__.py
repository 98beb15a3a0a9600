"""Queries over the given tables, each beside the SQL it must equal."""

from importlib import import_module

FAMILIES = (
    "apportionment", "levelling", "candidates", "geography", "calendars", "patterns", "ingest",
    "live",
)


def load_all():
    """Import every query family and return the registry."""
    for family in FAMILIES:
        import_module(f"civicspark.plans.{family}")
    return import_module("civicspark.plans.registry")
