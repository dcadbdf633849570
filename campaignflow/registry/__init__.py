"""Named queries over the driver's tables, grouped by operator family."""

from importlib import import_module

from campaignflow.registry.core import ORACLES, QUERIES

FAMILIES = ["features", "forecast", "groups", "hierarchy", "budget", "insights", "ingest", "calibration", "models"]


def _load():
    for family in FAMILIES:
        import_module(f"campaignflow.registry.{family}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
