"""Registered queries, by family."""

from importlib import import_module

FAMILIES = ("ordered", "measures", "columns", "verdicts", "comparisons", "operations", "ingest", "files")


def load_all():
    for family in FAMILIES:
        import_module(f"tempaudit.plans.{family}")
    from tempaudit.plans.common import ORACLES, QUERIES

    return QUERIES, ORACLES
