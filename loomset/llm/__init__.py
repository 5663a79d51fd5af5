"""Operators and queries for training text; nothing else in the library imports this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from loomset.llm import found

    return (found,)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
