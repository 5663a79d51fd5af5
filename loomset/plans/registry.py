"""All registered queries outside the subpackage for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomset.plans import auditing, coding, delivery, documents, packed, quality

MODULES = (packed, quality, coding, documents, auditing, delivery)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted rows, guarded and marked for review, each record once: the whole quality gate in one plan."""
    return quality.row_guards(spark, folder)
