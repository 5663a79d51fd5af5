"""The fix loop: repair rows, check them, and let only failing rows try again.

A fixer is any function from rows to rows; a model behind ``mapInPandas`` fits as
well as the built-in expressions.  Passes are bounded, every pass reads what
the last one left as failing from the shared folder, and rows that still fail
are kept and flagged, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.row_quality import review_status
from loomset.session import checkpointed

Fixer = Callable[[DataFrame], DataFrame]


def fix_loop(rows: DataFrame, fixers: list[Fixer], check: Fixer) -> DataFrame:
    """Rows with ``review_status``, ``review_issues`` and ``passes``; one fixer a pass.

    ``check`` adds ``issues`` (array of strings).
    """
    columns = rows.columns
    out, failing = [], rows
    for number, fix in enumerate(fixers, 1):
        checked = checkpointed(check(fix(failing).select(*columns)).withColumn("passes", F.lit(number)))
        out.append(checked if number == len(fixers) else checked.where(F.size("issues") == 0))
        failing = checked.where(F.size("issues") > 0).select(*columns)
    joined = out[0]
    for more in out[1:]:
        joined = joined.unionByName(more)
    status, issues = review_status(F.col("issues"))
    return joined.select(*columns, status.alias("review_status"), issues.alias("review_issues"), "passes")
