"""Registered queries over the test tables."""

from . import analytics, library, titles  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
