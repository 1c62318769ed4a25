"""Registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from lodestone.plans import code, documents, knowledge, libraries, projects, relational, searching, versioning, web  # noqa: F401  (they register their queries)
from lodestone.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
