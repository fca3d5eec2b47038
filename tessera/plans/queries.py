"""All registered queries of the engine and their SQL for comparison."""

from __future__ import annotations

from tessera.plans import announcements, collected, identity, observations, posts, relations, resolutions, sites, texts, timetables  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
