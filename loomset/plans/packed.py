"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomset.operators.packed_values import split_values
from loomset.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "extracted_rows").select("row_id", "grade_number", "review_issues")
    return split_values(rows, "row_id", ["grade_number", "review_issues"])


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
