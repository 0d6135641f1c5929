"""The engine's named queries over the star-schema tables, and their SQL."""

from __future__ import annotations

from karstflow.plans import oracles, queries

QUERIES = {f.__name__: f for f in queries.ALL}
ORACLES = oracles.sql()
