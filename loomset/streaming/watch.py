"""Structured Streaming: process files as they arrive, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomset.operators.processing import pending

STATE = "path string, fingerprint string, status string, retryable boolean, config_signature string, errors array<string>, processed_at_utc string"


def _state(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STATE)  # no batch has been written yet
    return spark.read.schema(STATE).parquet(folder)


def watch(spark: SparkSession, inbox: str, state: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], signature: str = "", every: str | None = None) -> StreamingQuery:
    """Run ``process`` on files of ``inbox`` whose content is new; log the outcome in the state table.

    With ``every`` ("10 seconds") the folder is polled until the query is stopped;
    without, the query ends when it has seen all files.

    ``process`` takes (path, content, fingerprint) and returns (path, status, errors).
    A file is known by the hash of its content, so one rewritten under its old
    name is due again and one touched without a change is not.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("cleanSource", "off").option("maxFilesPerTrigger", 1000).load(inbox)

    def batch(df: DataFrame, _: int) -> None:
        seen = df.select("path", "content", F.sha2("content", 256).alias("fingerprint"))
        due = pending(seen.select("path", "fingerprint"), _state(spark, state), signature).select("path", "fingerprint")
        done = process(seen.join(due, ["path", "fingerprint"]))
        log = done.join(due, "path").select("path", "fingerprint", "status", (F.col("status") == "pending_retry").alias("retryable"), F.lit(signature).alias("config_signature"), "errors", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at_utc"))
        log.write.mode("append").parquet(state)

    when = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**when).start()
