"""All registered queries."""

from voltfleet.plans import history, ingest, models, plant, reports, streams  # noqa: F401
from voltfleet.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
