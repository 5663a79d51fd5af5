"""Queries on audits, state, schema and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import filled, sql_list, sql_strip
from loomset.operators import audit, layout, processing, schema_inference
from loomset.sources.tables import table

FIXED = ["grade_level", "domain", "topic", "standard_code", "description"]
PROFILED = ["source", "grade_level", "grade_number", "subject", "l3", "l4", "l5", "standard_code", "description", "czi_standard_code", "review_status"]
SIGNATURE = "4e6a8c880b089576"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_rows")


def audit_long(spark: SparkSession, folder: str) -> DataFrame:
    return audit.programmatic_issues(_rows(spark, folder), "row_id", ["source", "domain", "subject", "description"], "display_standard_code")


def audit_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    findings = table(spark, folder, "audit_issues").distinct().withColumnRenamed("row_number", "row_id")
    return audit.verdicts(_rows(spark, folder), findings, "row_id").groupBy("final_verdict").agg(F.count("*").alias("n_rows"), F.sum("n_findings").alias("n_findings"))


def audit_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "audit_issues").distinct()
    off = F.coalesce("suppressed", F.lit(False))
    return found.groupBy("issue_type", F.coalesce("column_name", F.lit("")).alias("column_name")).agg(F.count("*").alias("findings"), F.sum(off.cast("int")).alias("suppressed"), F.sum((~off & (F.col("final_verdict") == "INVALID")).cast("int")).alias("open_invalid"))


def fix_merge(spark: SparkSession, folder: str) -> DataFrame:
    return audit.merged_fixes(_rows(spark, folder).select("row_id", *FIXED), table(spark, folder, "audit_issues"), "row_id", FIXED)


def batch_chunks(spark: SparkSession, folder: str) -> DataFrame:
    cut = audit.review_batches(_rows(spark, folder), "row_id", "source_document")
    return cut.groupBy("source_document", "batch").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def row_summary(spark: SparkSession, folder: str) -> DataFrame:
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.nullif(F.trim("source_document"), F.lit("")))
    return _rows(spark, folder).groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.countDistinct(source).alias("sources"), F.sum((F.coalesce("review_status", F.lit("")) != "").cast("int")).alias("flagged"), F.max("ingested_at").alias("last_ingested"))


def clean_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The deliverable: schema columns and review marks, null as blank."""
    names = ["source", *FIXED, "review_status", "review_issues"]
    return _rows(spark, folder).select("row_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    last = processing.latest_state(table(spark, folder, "processing_state").distinct())
    return last.select("path", "attempts", "processed_at_utc", "status", F.array_join("errors", " | ").alias("errors"))


def pending_files(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "parsed_documents").select(F.col("source_path").alias("path"), F.sha2("markdown", 256).alias("fingerprint"))
    return processing.pending(files, table(spark, folder, "processing_state").distinct(), SIGNATURE)


def retry_errors(spark: SparkSession, folder: str) -> DataFrame:
    state = table(spark, folder, "processing_state").distinct().select("path", "status", F.explode("errors").alias("error"))
    return state.groupBy("error", "status").agg(F.count("*").alias("entries"), F.countDistinct("path").alias("paths"))


def draft_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What speaks against taking each batch as a sample: issues of rows and of the batch, counted."""
    rows = _rows(spark, folder)
    code, text = filled(F.col("display_standard_code")), filled(F.col("description"))
    per = rows.groupBy("batch_id").agg(
        F.count("*").alias("n"),
        F.sum((text == "").cast("int")).alias("no_description"),
        F.sum((filled(F.col("l4")) != "").cast("int")).alias("l4_filled"),
        F.sum(filled(F.col("topic")).rlike(r"(?i)^cluster\s+\d+(\.\d+)*$").cast("int")).alias("generic_topic"),
        F.sum(F.coalesce(F.col("source").contains("sample_row="), F.lit(False)).cast("int")).alias("marked_source"),
        F.countDistinct(F.when(text != "", text)).alias("texts"),
        (F.count(F.when(code != "", 1)) - F.countDistinct(F.when(code != "", code))).alias("repeated_codes"),
    )
    found = {
        "too_few_rows": F.when(F.col("n") < 10, F.col("n")),
        "constant_description": F.when((F.col("texts") == 1) & (F.col("n") - F.col("no_description") > 1), F.col("n")),
        **{c: F.when(F.col(c) > 0, F.col(c)) for c in ("no_description", "l4_filled", "generic_topic", "marked_source", "repeated_codes")},
    }
    issues = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("issue"), v.cast("long").alias("n_rows"))) for k, v in found.items()]))
    return per.select("batch_id", F.inline(issues))


def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each batch passes: no open finding of a row says INVALID."""
    bad = audit.open_findings(table(spark, folder, "audit_issues")).where("final_verdict = 'INVALID'").groupBy(F.col("row_number").alias("row_id")).agg(F.count("*").alias("open"))
    rows = _rows(spark, folder).select("row_id", "batch_id").join(bad, "row_id", "left")
    out = rows.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("open"), F.lit(0)).alias("open_findings"))
    return out.withColumn("status", F.when(F.col("open_findings") > 0, "failed_audit").otherwise("passed_audit"))


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return schema_inference.column_profile(_rows(spark, folder), PROFILED, "row_id")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """Line items laid out as spans of pages: one document a supplier, one page a line number."""
    li = table(spark, folder, "lineitem")
    text = F.concat("l_returnflag", "l_linestatus")
    return li.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("span"), text.alias("text"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_extendedprice") / 100).alias("y0"), F.col("l_discount").alias("size"))


def track_discovery(spark: SparkSession, folder: str) -> DataFrame:
    return layout.tracks(_spans(spark, folder)).select("doc", "text", "n", F.col("rank").cast("long").alias("rank"))


def column_geometry(spark: SparkSession, folder: str) -> DataFrame:
    return layout.column_edges(_spans(spark, folder)).select("doc", "densest", "left")


def nearest_track(spark: SparkSession, folder: str) -> DataFrame:
    """For each returned item the nearest open one of its page."""
    spans = _spans(spark, folder).groupBy("doc", "page", "text", "span").agg(F.min("y0").alias("y0"))
    left = spans.where("text = 'RF'").select("doc", "page", F.col("span").alias("marker"), F.col("y0").alias("marker_y"))
    right = spans.where("text = 'NO'").select("doc", "page", F.col("span").alias("item"), F.col("y0").alias("item_y"))
    return layout.nearest(left, right, ["doc", "page"], "marker", "item", "marker_y", "item_y", layout.ITEM_REACH).select("doc", "page", "marker", "item", F.round("distance", 6).alias("distance"))


def item_text(spark: SparkSession, folder: str) -> DataFrame:
    spans = _spans(spark, folder)
    items = spans.where("x0 <= 20").groupBy("doc", "page", F.col("span").alias("item")).agg(F.min("y0").alias("item_y"))
    return layout.item_text(items, spans)


def page_headings(spark: SparkSession, folder: str) -> DataFrame:
    return layout.page_headings(_spans(spark, folder)).select("doc", "page", F.round("baseline", 6).alias("baseline"), "headings", "blocks")


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN count(*) FILTER (v <> '') = 0 THEN 'string' WHEN bool_and(lower(v) IN ({sql_list(schema_inference.BOOLEANS)})) FILTER (v <> '') THEN 'boolean'
    WHEN bool_and(regexp_matches(v, '{schema_inference.WHOLE}')) FILTER (v <> '') THEN 'integer' WHEN bool_and(regexp_matches(v, '{schema_inference.NUMBER}')) FILTER (v <> '') THEN 'number' ELSE 'string' END AS type,
    count(*) FILTER (v <> '') > 0 AND {str(c not in schema_inference.OPTIONAL).upper()} AS required, count(*) FILTER (v <> '') = 0 AND count(*) >= 2 AS always_empty, arg_min(v, row_id) FILTER (v <> '') AS first_example, count(*) FILTER (v <> '') AS n_filled,
    coalesce(bool_or(contains(v, '(') AND contains(v, ')')) FILTER (v <> ''), false) AS any_parenthesis, coalesce(bool_or(contains(v, chr(10))) FILTER (v <> ''), false) AS any_line, coalesce(bool_or(regexp_matches(v, '[^\\x00-\\x7F]')) FILTER (v <> ''), false) AS any_beyond_ascii
    FROM (SELECT row_id, {sql_strip(c)} AS v FROM extracted_rows)"""
    for c in PROFILED
)
_SPANS = "s AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey AS span, l_returnflag || l_linestatus AS text, l_quantity * 10 AS x0, l_extendedprice / 100 AS y0, l_discount AS size FROM lineitem)"
_LAST = "st AS (SELECT DISTINCT * FROM processing_state WHERE path IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY processed_at_utc DESC NULLS LAST, fingerprint DESC NULLS LAST, status DESC NULLS LAST) AS k, count(*) OVER (PARTITION BY path) AS attempts FROM st), last AS (SELECT * FROM k WHERE k = 1)"
_OPEN = "o AS (SELECT DISTINCT * FROM audit_issues), f AS (SELECT row_number AS row_id, column_name, regexp_extract(suggested_fix, '^use ''(.*)''$', 1) AS new, logged_at_utc FROM o WHERE NOT coalesce(suppressed, false) AND regexp_matches(suggested_fix, '^use ''(.*)''$'))"
_LATEST = ", ".join(f"arg_max(new, logged_at_utc || '#' || new) FILTER (column_name = '{c}') AS fix_{c}" for c in FIXED)

QUERIES = {f.__name__: f for f in (audit_long, audit_verdicts, audit_suppressed, fix_merge, batch_chunks, row_summary, clean_projection, latest_state, pending_files, retry_errors, draft_audit, batch_status, column_profile, track_discovery, column_geometry, nearest_track, item_text, page_headings)}
ORACLES = {
    "audit_long": " UNION ALL ".join([f"SELECT row_id, 'missing_required_value' AS issue_type, '{c}' AS column_name, 'Required column ''{c}'' is blank.' AS issue_message FROM extracted_rows WHERE {sql_strip(c)} = ''" for c in ("source", "domain", "subject", "description")])
    + f" UNION ALL SELECT row_id, 'duplicate_display_standard_code', 'display_standard_code', 'Display standard code ''' || code || ''' is borne by ' || n || ' rows, first row ' || f || '.' FROM (SELECT row_id, code, count(*) OVER (PARTITION BY code) AS n, min(row_id) OVER (PARTITION BY code) AS f FROM (SELECT row_id, {sql_strip('display_standard_code')} AS code FROM extracted_rows)) WHERE code <> '' AND n > 1",
    "audit_verdicts": """WITH j AS (SELECT row_number AS row_id, count(*) AS n, max((final_verdict = 'INVALID')::INT) AS bad FROM (SELECT DISTINCT * FROM audit_issues) GROUP BY 1),
        v AS (SELECT CASE WHEN bad IS NULL OR bad = 1 THEN 'INVALID' ELSE 'VALID' END AS final_verdict, coalesce(n, 0) AS n FROM extracted_rows LEFT JOIN j USING (row_id)) SELECT final_verdict, count(*) AS n_rows, sum(n)::BIGINT AS n_findings FROM v GROUP BY 1""",
    "audit_suppressed": "SELECT issue_type, coalesce(column_name, '') AS column_name, count(*) AS findings, sum(coalesce(suppressed, false)::INT)::BIGINT AS suppressed, sum((NOT coalesce(suppressed, false) AND final_verdict = 'INVALID')::INT)::BIGINT AS open_invalid FROM (SELECT DISTINCT * FROM audit_issues) GROUP BY 1, 2",
    "fix_merge": f"WITH {_OPEN}, w AS (SELECT row_id, {_LATEST} FROM f GROUP BY row_id) SELECT e.row_id, {', '.join(f'coalesce(fix_{c}, e.{c}) AS {c}' for c in FIXED)}, ({' + '.join(f'(fix_{c} IS NOT NULL AND fix_{c} IS DISTINCT FROM e.{c})::INT' for c in FIXED)}) AS n_changed FROM extracted_rows e LEFT JOIN w ON e.row_id = w.row_id",
    "batch_chunks": "WITH n AS (SELECT row_id, source_document, (row_number() OVER (PARTITION BY source_document ORDER BY row_id) - 1) // 12 AS batch FROM extracted_rows) SELECT source_document, batch, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row FROM n GROUP BY ALL",
    "row_summary": "SELECT batch_id, count(*) AS n_rows, count(DISTINCT coalesce(nullif(trim(source, ' '), ''), nullif(trim(source_document, ' '), ''))) AS sources, sum((coalesce(review_status, '') <> '')::INT)::BIGINT AS flagged, max(ingested_at) AS last_ingested FROM extracted_rows GROUP BY batch_id",
    "clean_projection": f"SELECT row_id, {', '.join(f'coalesce({c}, {chr(39)}{chr(39)}) AS {c}' for c in ['source', *FIXED, 'review_status', 'review_issues'])} FROM extracted_rows",
    "latest_state": f"WITH {_LAST} SELECT path, attempts, processed_at_utc, status, coalesce(array_to_string(errors, ' | '), '') AS errors FROM last",
    "pending_files": f"""WITH {_LAST} SELECT source_path AS path, sha256(markdown) AS fingerprint, status FROM parsed_documents d LEFT JOIN last l ON d.source_path = l.path
        WHERE NOT coalesce(l.fingerprint = sha256(markdown) AND (status IN ('verified', 'processed', 'manual_review') OR (status = 'pending_retry' AND config_signature IS NOT DISTINCT FROM '{SIGNATURE}')), false)""",
    "retry_errors": "SELECT error, status, count(*) AS entries, count(DISTINCT path) AS paths FROM (SELECT path, status, unnest(errors) AS error FROM (SELECT DISTINCT * FROM processing_state)) GROUP BY ALL",
    "draft_audit": f"""WITH r AS (SELECT batch_id, {sql_strip('description')} AS d, {sql_strip('l4')} AS l4, {sql_strip('topic')} AS t, {sql_strip('display_standard_code')} AS c, coalesce(contains(source, 'sample_row='), false) AS m FROM extracted_rows),
        p AS (SELECT batch_id, count(*) AS n, count(*) FILTER (d = '') AS no_description, count(*) FILTER (l4 <> '') AS l4_filled, count(*) FILTER (regexp_matches(t, '(?i)^cluster\\s+\\d+(\\.\\d+)*$')) AS generic_topic,
            count(*) FILTER (m) AS marked_source, count(DISTINCT d) FILTER (d <> '') AS texts, count(*) FILTER (c <> '') - count(DISTINCT c) FILTER (c <> '') AS repeated_codes FROM r GROUP BY 1),
        i AS (SELECT batch_id, unnest([{{'issue': 'too_few_rows', 'n_rows': CASE WHEN n < 10 THEN n END}}, {{'issue': 'constant_description', 'n_rows': CASE WHEN texts = 1 AND n - no_description > 1 THEN n END}},
            {", ".join(f"{{'issue': '{x}', 'n_rows': nullif({x}, 0)}}" for x in ("no_description", "l4_filled", "generic_topic", "marked_source", "repeated_codes"))}], recursive := true) FROM p)
        SELECT batch_id, issue, n_rows FROM i WHERE n_rows IS NOT NULL""",
    "batch_status": """WITH b AS (SELECT row_number AS row_id, count(*) AS o FROM (SELECT DISTINCT * FROM audit_issues) WHERE NOT coalesce(suppressed, false) AND final_verdict = 'INVALID' GROUP BY 1)
        SELECT batch_id, count(*) AS n_rows, coalesce(sum(o), 0)::BIGINT AS open_findings, CASE WHEN coalesce(sum(o), 0) > 0 THEN 'failed_audit' ELSE 'passed_audit' END AS status FROM extracted_rows LEFT JOIN b USING (row_id) GROUP BY 1""",
    "column_profile": _PROFILE,
    "track_discovery": f"WITH {_SPANS}, c AS (SELECT doc, text, count(*) AS n FROM s WHERE x0 >= 400 AND length(text) BETWEEN 2 AND 8 AND regexp_matches(text, '^[A-Z]') GROUP BY ALL HAVING count(*) >= 6) SELECT * FROM (SELECT doc, text, n, row_number() OVER (PARTITION BY doc ORDER BY n DESC, text) AS rank FROM c) WHERE rank <= 5",
    "column_geometry": f"WITH {_SPANS}, b AS (SELECT doc, round_even(x0, 0) AS edge, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT doc, max(n) AS densest FROM b GROUP BY doc HAVING max(n) >= 4) SELECT doc, densest, min(edge) AS \"left\" FROM b JOIN t USING (doc) WHERE n >= greatest(4, densest // 2) GROUP BY doc, densest",
    "nearest_track": f"""WITH {_SPANS}, g AS (SELECT doc, page, text, span, min(y0) AS y0 FROM s GROUP BY ALL),
        p AS (SELECT l.doc, l.page, l.span AS marker, r.span AS item, abs(l.y0 - r.y0) AS distance FROM g l JOIN g r ON l.doc = r.doc AND l.page = r.page AND l.text = 'RF' AND r.text = 'NO' AND abs(l.y0 - r.y0) <= {layout.ITEM_REACH})
        SELECT doc, page, marker, item, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, marker ORDER BY distance, item) AS k FROM p) WHERE k = 1""",
    "item_text": f"""WITH {_SPANS}, i AS (SELECT doc, page, span AS item, min(y0) AS item_y FROM s WHERE x0 <= 20 GROUP BY ALL)
        SELECT i.doc, i.page, item, count(*) AS n_spans, string_agg(text, ' ' ORDER BY y0, x0, span, text) AS text FROM i JOIN s ON i.doc = s.doc AND i.page = s.page AND abs(item_y - y0) <= {layout.TEXT_REACH} GROUP BY ALL""",
    "page_headings": f"WITH {_SPANS}, b AS (SELECT doc, page, median(size) AS baseline FROM s GROUP BY ALL) SELECT doc, page, round(baseline, 6) AS baseline, sum((size >= {layout.HEADING} * baseline)::INT)::BIGINT AS headings, count(*) AS blocks FROM s JOIN b USING (doc, page) GROUP BY ALL",
}
