"""Queries on codes and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import sql_strip
from loomset.operators import codes
from loomset.sources.tables import table

KEY = ["source_document", "source", "subject", "domain", "topic", "standard_code", "display_standard_code", "description"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_rows")


def exact_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    kept = codes.exact_repeats_removed(_rows(spark, folder).select("row_id", *KEY), KEY, "row_id")
    return kept.select("row_id", "source_document", "display_standard_code")


def duplicate_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.duplicate_codes(_rows(spark, folder), "display_standard_code", "row_id")


def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose code another row of their batch bears, or a row of an earlier batch."""
    rows = _rows(spark, folder).select("row_id", "batch_id", F.col("display_standard_code").alias("code")).where(F.trim("code") != "")
    within = rows.groupBy("batch_id", "code").agg(F.count("*").alias("n"))
    first = rows.groupBy("code").agg(F.min("batch_id").alias("first_batch"))
    marked = within.join(first, "code").select("batch_id", "code", (F.col("n") > 1).alias("in_batch"), (F.col("first_batch") < F.col("batch_id")).alias("before"))
    return marked.where("in_batch or before").groupBy("batch_id").agg(F.count("*").alias("codes"), F.sum(F.col("in_batch").cast("int")).alias("in_batch"), F.sum(F.col("before").cast("int")).alias("before"))


def code_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("row_id", F.array_join(codes.prefix_candidates(F.col("domain"), F.col("topic")), ",").alias("prefixes"))


def code_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).where("standard_code is not null").select("row_id", codes.code_suffix_raised(F.col("standard_code"), 7).alias("raised"))


def resolve_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return codes.resolved_collisions(_rows(spark, folder), "row_id", "display_standard_code", ["domain", "topic"])


def same_codes_differ(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of a document that stand for more than one description."""
    rows = _rows(spark, folder).where("standard_code is not null and trim(description) != ''")
    return rows.groupBy("source_identifier", "standard_code").agg(F.countDistinct(F.lower(F.trim("description"))).alias("descriptions"), F.count("*").alias("n_rows")).where("descriptions > 1")


def _sql_forms(p: str) -> str:
    tokens = f"regexp_extract_all(upper({p}), '[A-Z0-9]+')"
    sources = [f"array_to_string(list_transform({tokens}, lambda t: t[1]), '')", f"array_to_string({tokens}, '')"]
    return "[" + ", ".join(f"CASE WHEN length({s}) >= {n} THEN {s}[1:{n}] END" for s in sources for n in (2, 3, 4)) + "]"


QUERIES = {f.__name__: f for f in (exact_dedupe, duplicate_codes, unique_violations, code_prefixes, code_suffixes, resolve_collisions, same_codes_differ)}
ORACLES = {
    "exact_dedupe": f"SELECT row_id, source_document, display_standard_code FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(KEY)} ORDER BY row_id) AS r FROM extracted_rows) WHERE r = 1",
    "duplicate_codes": f"SELECT code, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row FROM (SELECT row_id, {sql_strip('display_standard_code')} AS code FROM extracted_rows) WHERE code <> '' GROUP BY code HAVING count(*) > 1",
    "unique_violations": """WITH r AS (SELECT batch_id, display_standard_code AS code FROM extracted_rows WHERE trim(display_standard_code) <> ''),
        w AS (SELECT batch_id, code, count(*) > 1 AS in_batch FROM r GROUP BY ALL), f AS (SELECT code, min(batch_id) AS first_batch FROM r GROUP BY code),
        m AS (SELECT batch_id, in_batch, first_batch < batch_id AS before FROM w JOIN f USING (code))
        SELECT batch_id, count(*) AS codes, sum(in_batch::INT) AS in_batch, sum(before::INT) AS before FROM m WHERE in_batch OR before GROUP BY batch_id""",
    "code_prefixes": f"""WITH p AS (SELECT row_id, list_filter(list_transform(string_split({sql_strip('domain')}, '|') || string_split({sql_strip('topic')}, '|'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts FROM extracted_rows),
        c AS (SELECT row_id, list_filter(flatten(list_transform(parts, lambda q: {_sql_forms('q')})), lambda v: v IS NOT NULL) AS v FROM p)
        SELECT row_id, coalesce(array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ','), '') AS prefixes FROM c""",
    "code_suffixes": r"""WITH c AS (SELECT row_id, standard_code AS c, regexp_extract(standard_code, '^(.*?)([0-9]+)([^0-9]*)$', ['h', 'd', 't']) AS g FROM extracted_rows WHERE standard_code IS NOT NULL)
        SELECT row_id, CASE WHEN g.d = '' THEN c || '.8' ELSE g.h || lpad((try_cast(g.d AS BIGINT) + 7)::VARCHAR, greatest(length(g.d), length((try_cast(g.d AS BIGINT) + 7)::VARCHAR))::INT, '0') || g.t END AS raised FROM c""",
    "same_codes_differ": "SELECT source_identifier, standard_code, count(DISTINCT lower(trim(description))) AS descriptions, count(*) AS n_rows FROM extracted_rows WHERE standard_code IS NOT NULL AND trim(description) <> '' GROUP BY ALL HAVING count(DISTINCT lower(trim(description))) > 1",
}
