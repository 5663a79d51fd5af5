"""The queries of the training-text problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import canonical_list, formatting_copies, leakage, lookalike, oracle_sql, packing, page_boilerplate, residue, scanned_pages


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scanned_pages.page_noise(_table(spark, folder, "parsed_documents"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scanned_pages.repaired_texts(_table(spark, folder, "parsed_documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "extracted_rows").select("row_id", "grade_level", "display_grade")
    return canonical_list.canonical_entries(rows, _table(spark, folder, "grade_labels"), "row_id", ["grade_level", "display_grade"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_boilerplate.boilerplate_lines(_table(spark, folder, "parsed_documents"))


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return page_boilerplate.main_bodies(_table(spark, folder, "parsed_documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "extracted_rows").select("row_id", "source_document", "description")
    return formatting_copies.formatting_copies(rows, "row_id", "description", ["source_document"]).select("first_row_id", "row_id")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, with the number of its copies."""
    rows = _table(spark, folder, "extracted_rows").select("row_id", "source_document", "description")
    return formatting_copies.records(rows, "row_id", "description", ["source_document"])


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every description and text that isn't in it."""
    rows = lookalike.consistent_text(_table(spark, folder, "extracted_rows").select(F.col("row_id").cast("string").alias("record_id"), F.col("description").alias("text")), "text")
    pages = lookalike.consistent_text(_table(spark, folder, "parsed_documents").select(F.col("document_id").alias("record_id"), F.col("markdown").alias("text")), "text")
    return rows.withColumn("field_name", F.lit("description")).unionByName(pages.withColumn("field_name", F.lit("markdown"))).where("changed").select("field_name", "record_id", "consistent").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = lookalike.inconsistent_records(_table(spark, folder, "extracted_rows"), "description", "description", "row_id")
    pages = lookalike.inconsistent_records(_table(spark, folder, "parsed_documents"), "markdown", "markdown", "document_id")
    return rows.unionByName(pages)


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, size, bin) for all documents in containers of 2,048 tokens."""
    sizes = packing.token_sizes(_table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks of each item: documents, and the largest share of its shingles found in one."""
    pairs = leakage.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))
    return pairs.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("containment"), 6).alias("most"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_table(spark, folder, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p4_found": p4_found, "p4_bodies": p4_bodies, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_pack": p7_pack, "p8_found": p8_found, "p8_containment": p8_containment, "p9_found": p9_found}
ORACLES: dict[str, str] = oracle_sql.ORACLES
