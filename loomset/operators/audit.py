"""Audit of extracted rows: issues in long form, suppression, fixes merged back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import filled
from loomset.operators.codes import duplicate_codes
from loomset.operators.numbering import numbered

BATCH = 12
FIX = r"^use '(.*)'$"


def programmatic_issues(rows: DataFrame, number: str, required: list[str], code: str) -> DataFrame:
    """(number, issue_type, column_name, issue_message) of every row: blanks, and codes borne by several rows.

    The message of a duplicate names the number of its rows and the first one;
    a list of all rows would grow with the table.
    """
    blanks = F.array_compact(F.array(*[F.when(filled(F.col(c)) == "", F.struct(F.lit("missing_required_value").alias("issue_type"), F.lit(c).alias("column_name"), F.lit(f"Required column '{c}' is blank.").alias("issue_message"))) for c in required]))
    missing = rows.select(number, F.inline(blanks))
    repeated = rows.select(number, filled(F.col(code)).alias("code")).join(duplicate_codes(rows, code, number), "code")
    message = F.concat(F.lit("Display standard code '"), "code", F.lit("' is borne by "), F.col("n_rows").cast("string"), F.lit(" rows, first row "), F.col("first_row").cast("string"), F.lit("."))
    return missing.unionByName(repeated.select(number, F.lit("duplicate_display_standard_code").alias("issue_type"), F.lit(code).alias("column_name"), message.alias("issue_message")))


def verdicts(rows: DataFrame, findings: DataFrame, number: str) -> DataFrame:
    """(number, final_verdict, n_findings): the judged verdict of every row; rows nobody judged are INVALID."""
    judged = findings.groupBy(number).agg(F.count("*").alias("n_findings"), F.max((F.col("final_verdict") == "INVALID").cast("int")).alias("bad"))
    verdict = F.when(F.col("bad").isNull() | (F.col("bad") == 1), "INVALID").otherwise("VALID")
    return rows.select(number).join(judged, number, "left").select(number, verdict.alias("final_verdict"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def open_findings(findings: DataFrame) -> DataFrame:
    """Distinct findings that nobody suppressed."""
    return findings.distinct().where(~F.coalesce("suppressed", F.lit(False)))


def merged_fixes(rows: DataFrame, findings: DataFrame, number: str, columns: list[str]) -> DataFrame:
    """Rows with the latest open fix of each column put in, and ``n_changed``."""
    fixes = open_findings(findings).where(F.col("suggested_fix").rlike(FIX)).where(F.col("column_name").isin(columns))
    fixes = fixes.withColumn("new", F.regexp_extract("suggested_fix", FIX, 1))
    latest = [F.max_by(F.when(F.col("column_name") == c, F.col("new")), F.when(F.col("column_name") == c, F.struct("logged_at_utc", "new"))).alias(f"fix_{c}") for c in columns]
    wide = fixes.groupBy(F.col("row_number").alias(number)).agg(*latest)
    joined = rows.join(wide, number, "left")
    changed = sum((F.coalesce(~F.col(f"fix_{c}").eqNullSafe(F.col(c)) & F.col(f"fix_{c}").isNotNull(), F.lit(False)).cast("int") for c in columns), F.lit(0))
    return joined.withColumn("n_changed", changed).select(number, *[F.coalesce(F.col(f"fix_{c}"), F.col(c)).alias(c) for c in columns], "n_changed")


def review_batches(rows: DataFrame, number: str, source: str, size: int = BATCH) -> DataFrame:
    """(number, source, batch): the rows of a source in order, ``size`` to a batch."""
    return numbered(rows.select(number, source), source, number, "n", 0).select(number, source, F.floor(F.col("n") / size).cast("long").alias("batch"))
