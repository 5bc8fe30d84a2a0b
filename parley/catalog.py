"""All registered queries over the meeting tables and their SQL."""

from __future__ import annotations

from .plans import calendar, histories, landed, store, texts  # noqa: F401  (registration)
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
