"""All registered queries."""

from skyloom.plans import (  # noqa: F401
    catalog_feeds,
    catalog_ingest,
    catalog_routes,
    catalog_search,
    catalog_spatial,
    catalog_stream,
)
from skyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
