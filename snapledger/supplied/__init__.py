"""Importing the query modules registers their queries."""

from snapledger.supplied import (  # noqa: F401
    fixture_queries,
    matching_queries,
    nested_queries,
    quality_queries,
    serving_queries,
    snapshot_queries,
)
from snapledger.supplied.registry import QUERIES, run

__all__ = ["QUERIES", "run"]
