"""All registered queries (import order is listing order)."""

from plantloom.plans import (  # noqa: F401
    catalog_models,
    catalog_quality,
    catalog_series,
    catalog_stats,
)
from plantloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
