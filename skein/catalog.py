"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from skein import source_queries, structure_queries, summary_queries, verification_queries
from skein.queries import QUERIES, SQL

MODULES = (structure_queries, verification_queries, summary_queries, source_queries)

__all__ = ["MODULES", "QUERIES", "SQL"]
