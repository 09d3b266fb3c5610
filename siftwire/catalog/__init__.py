"""All checked queries by name."""

from __future__ import annotations

from . import corpus, features, links, rules, streams  # noqa: F401  (they fill the registry)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
