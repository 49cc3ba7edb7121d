"""All queries over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from geospan.plans import aggregates, extras, focal, map_algebra, networks, streams, vector  # noqa: F401
from geospan.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
