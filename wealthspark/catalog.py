"""Every registered query of the library's own operators, with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from .queries import jobs, metrics, spatial, stats, survey
from .queries.base import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["GX1_population_features"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "jobs", "metrics", "spatial", "stats", "survey"]
