"""Schema and contract of a table of strings, learned in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.functions.text import filled

#: What counts as a boolean, and how whole and other numbers are written.
BOOLEANS = ["true", "false", "yes", "no", "0", "1"]
WHOLE = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
#: Columns that a sample may leave out.
OPTIONAL = ["l3", "l4", "l5", "standard code", "standard_code", "czi_standard_code"]
SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def column_profile(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(column, type, required, always_empty, first_example, n_filled, any_parenthesis, any_line, any_beyond_ascii)."""

    # Stripped once, read by every test below.
    stripped = rows.select(F.col(order).alias("order"), *[filled(F.col(f"`{c}`")).alias(f"value {i}") for i, c in enumerate(columns)])

    def profile(i: int, c: str) -> Column:
        value = F.col(f"value {i}")
        has = value != ""
        every = lambda test: F.bool_and(F.when(has, test))
        any_of = lambda test: F.coalesce(F.bool_or(F.when(has, test)), F.lit(False))
        n = F.count(F.when(has, 1))
        kind = F.when(n == 0, "string").when(every(F.lower(value).isin(BOOLEANS)), "boolean").when(every(value.rlike(WHOLE)), "integer").when(every(value.rlike(NUMBER)), "number").otherwise("string")
        return F.struct(
            F.lit(c).alias("column"),
            kind.alias("type"),
            ((n > 0) & F.lit(c.lower() not in OPTIONAL)).alias("required"),
            ((n == 0) & (F.count("*") >= 2)).alias("always_empty"),
            F.min_by(F.when(has, value), F.when(has, F.col("order"))).alias("first_example"),
            n.alias("n_filled"),
            any_of(value.rlike(r"\(") & value.rlike(r"\)")).alias("any_parenthesis"),
            any_of(value.contains("\n")).alias("any_line"),
            any_of(value.rlike(r"[^\x00-\x7F]")).alias("any_beyond_ascii"),
        )

    return stripped.agg(F.array(*[profile(i, c) for i, c in enumerate(columns)]).alias("p")).select(F.inline("p"))


def slug(header: str, used: set[str]) -> str:
    """A field name for a header: lower case, underscores, a number where it would repeat."""
    name = "".join(c if c.isascii() and c.isalnum() else " " for c in header.lower())
    name = "_".join(name.split()) or "column"
    name = name if name[0].isalpha() else f"field_{name}"
    out, n = name, 2
    while out in used:
        out, n = f"{name}_{n}", n + 1
    used.add(out)
    return out


def inferred_schema(rows: DataFrame, columns: list[str], order: str) -> T.StructType:
    """The Spark schema of a sample; one row for each column comes to the driver."""
    used: set[str] = set()
    kinds = {r["column"]: r for r in column_profile(rows, columns, order).collect()}
    return T.StructType([T.StructField(slug(c, used), SPARK_TYPES[kinds[c]["type"]], True, {"header": c, "required": kinds[c]["required"]}) for c in columns])
