"""Registered queries, each with the ANSI SQL that checks it."""

from lodestone.catalog.registry import ORACLES, QUERIES
from lodestone.catalog import code, retrieval, text, vectors  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
