"""All registered queries."""

from sentispark.plans import functions, ingest, matching, results, store, streams  # noqa: F401
from sentispark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
