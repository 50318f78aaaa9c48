"""All queries by name, with their SQL."""

from __future__ import annotations

from . import ranking  # noqa: F401  (first: others build on its SQL)
from . import judging, learning, nested, rollups, scenes, selection, slates, sources, tables  # noqa: F401  (they register their queries)
from .evaluation import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
