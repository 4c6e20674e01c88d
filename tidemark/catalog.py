"""Registry of queries and the SQL that each is checked against."""

from __future__ import annotations

from tidemark.plans import streams as _streams  # registers its queries
from tidemark.plans.queries import QUERIES, SQL

FLAGSHIP = "tumbling_sum_keyed"

__all__ = ["_streams", "FLAGSHIP", "QUERIES", "SQL"]
