"""Queries: plans over the operators, each a function of (session, data folder), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("problems", "profiles", "rollups", "spatial", "statistics", "texts", "files", "details", "further")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(f"sitegrid.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"sitegrid.plans.{m}").ORACLE.items()}
