"""All queries of the engine and the SQL of those that SQL can state."""

from __future__ import annotations

from . import cases, detection, features, graphs, loads, models, streams  # noqa: F401  (each registers its queries)
from .oracles import ORACLE_SQL
from .queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
