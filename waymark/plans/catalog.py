"""Named queries over the test tables, with the SQL that must give the same rows."""

from waymark.plans import fleet_queries, matching_queries, span_queries, trip_queries
from waymark.plans.trip_queries import flagship

QUERIES: dict = {}
ORACLES: dict = {}
for part in (trip_queries, fleet_queries, span_queries, matching_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]
