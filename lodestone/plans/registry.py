"""All queries of the library and their SQL twins."""

from __future__ import annotations

from lodestone.plans import audit, events, matching, selection, streams, terms  # noqa: F401
from lodestone.plans.catalog import ORACLES, QUERIES

FLAGSHIP = "a11_top_terms"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
