"""All registered queries of this package, and their SQL."""

from __future__ import annotations

from spoolsight.plans import adapter_queries, more_queries, search_queries, upkeep_queries  # noqa: F401  they register
from spoolsight.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
