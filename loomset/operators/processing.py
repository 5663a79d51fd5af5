"""State of processing: what is done, what is due again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States after which an unchanged file is left alone.
DONE = ["verified", "processed", "manual_review"]


def latest_state(state: DataFrame) -> DataFrame:
    """The last entry of every path; of entries of one time the one with the greatest fingerprint."""
    rest = F.struct("fingerprint", "status", "retryable", "config_signature", "errors")
    order = F.struct("processed_at_utc", "fingerprint", "status")
    return state.where("path is not null").groupBy("path").agg(F.count("*").alias("attempts"), F.max("processed_at_utc").alias("processed_at_utc"), F.max_by(rest, order).alias("s")).select("path", "attempts", "processed_at_utc", "s.*")


def pending(files: DataFrame, state: DataFrame, signature: str) -> DataFrame:
    """Files (path, fingerprint) that are new or changed, failed, or due for a retry under another configuration."""
    last = latest_state(state).select("path", F.col("fingerprint").alias("seen"), "status", "config_signature")
    done = F.col("status").isin(DONE) | ((F.col("status") == "pending_retry") & F.col("config_signature").eqNullSafe(F.lit(signature)))
    return files.join(last, "path", "left").where(~F.coalesce((F.col("seen") == F.col("fingerprint")) & done, F.lit(False))).select("path", "fingerprint", "status")
