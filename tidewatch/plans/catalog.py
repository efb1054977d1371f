"""All registered queries."""

from tidewatch.plans import (alert_queries, check_queries, lineage_queries, metric_queries, repair_queries, silver_queries, stream_queries)  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
