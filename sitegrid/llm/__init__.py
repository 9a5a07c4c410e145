"""Operators for training data and for matching at scale; nothing else in the library imports this package."""

from sitegrid.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
