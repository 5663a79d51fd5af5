"""Queries on delivery: rebuilt lines, links, sources, drafts, gates, statuses, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import filled, sql_strip
from loomset.operators import audit, delivery
from loomset.operators import documents as dx
from loomset.sources.tables import table

#: Words of links that lead to no document of an index.
NOISE = ["assessment", "support material", "support", "resource", "record of changes", "glossary", "schedule", "advice", "fact sheet", "cover sheet", "errata"]
DROPPED = ["sample_row", "ref"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_rows")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the documents as a layout gives them: spans of five characters, a gap before every third."""
    lines = table(spark, folder, "parsed_documents").where("markdown is not null").select("document_id", F.posexplode(F.split("markdown", "\n")).alias("line", "whole")).where("whole != ''")
    spans = lines.select("document_id", "line", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / 5).cast("int"))).alias("span"))
    text = F.substr("whole", F.col("span") * 5 + 1, F.lit(5))
    x0 = F.col("span") * 30.0 + F.floor(F.col("span") / 3) * 3.0
    size = F.when(F.col("whole").startswith("#"), 14.0).otherwise(10.0)
    return spans.select("document_id", "line", "span", text.alias("text"), x0.alias("x0"), (x0 + 6.0 * F.length(text)).alias("x1"), size.alias("size"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.joined_lines(_spans(spark, folder), ["document_id", "line"])


def line_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("document_id", F.col("line").cast("long").alias("line"), "text", "size")


def block_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of ten lines: their text and the mean size of their lines."""
    lines = _lines(spark, folder).withColumn("block", F.floor(F.col("line") / 10))
    return delivery.blocks_of(lines, ["document_id", "block"], "line").select("document_id", "block", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), F.round("size", 6).alias("size"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.document_links(dx.links(table(spark, folder, "parsed_documents"), "document_id", "markdown"), "document_id", NOISE)


def document_link_list(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("document_id", F.col("pos").cast("long").alias("pos"), "url", "label")


def index_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose links lead on, and whether they are enough to be read as an index."""
    return delivery.index_pages(dx.links(table(spark, folder, "parsed_documents"), "document_id", "markdown"), "document_id")


def canonical_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "parsed_documents").select("document_id", F.col("source_path").alias("path"), F.element_at("metadata", "url").alias("url"), "source_type")
    origins = documents.where("source_type = 'website'").select("path", F.regexp_replace("url", r"[?#].*$", "").alias("origin"))
    rows = _rows(spark, folder).select("row_id", F.col("source_identifier").alias("document_id"), "source")
    return delivery.stamped_sources(rows, documents, origins).select("row_id", "source")


DRAFT = ["display_grade", "grade_number", "domain", "topic", "l4", "standard_code", "description"]


def sample_drafts(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.draft_rows(_rows(spark, folder).select("batch_id", "row_id", *DRAFT), "batch_id", "row_id").select("batch_id", "row_id", *DRAFT)


def template_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Ten example rows for each subject, counted on from its first code and grade."""
    first = _rows(spark, folder).where("subject is not null").groupBy("subject").agg(F.min_by(F.struct("standard_code", "grade_number"), "row_id").alias("f"))
    each = first.select("subject", "f.*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("n"))
    return each.select("subject", F.col("n").cast("long").alias("n"), delivery.expanded_example(F.col("standard_code"), F.col("n")).alias("standard_code"), delivery.expanded_example(F.col("grade_number"), F.col("n")).alias("grade_number"))


def citation_constraint(spark: SparkSession, folder: str) -> DataFrame:
    gap = delivery.citation_gaps(F.col("description"), F.col("description_source_citation"))
    return _rows(spark, folder).select("row_id", "batch_id", gap.alias("gap")).where("gap is not null")


def retryable_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What the errors of each attempt say of another try, beside what was noted."""
    state = table(spark, folder, "processing_state").distinct()
    return state.groupBy(delivery.retryable(F.col("errors")).alias("by_errors"), F.coalesce("retryable", F.lit(False)).alias("noted")).agg(F.count("*").alias("attempts"), F.countDistinct("path").alias("paths"))


def verdict_issues(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "audit_issues")
    return delivery.first_verdicts(found, "row_number", [F.coalesce("logged_at_utc", F.lit("")), F.coalesce("issue_type", F.lit("")), F.coalesce("column_name", F.lit("")), F.coalesce("issue_message", F.lit("")), F.coalesce("final_verdict", F.lit(""))])


def full_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select("row_id", F.col("source_identifier").alias("document_id"))
    findings = audit.open_findings(table(spark, folder, "audit_issues")).where("final_verdict = 'INVALID'").select(F.col("row_number").alias("row_id"), "issue_type")
    return delivery.audited(rows, table(spark, folder, "parsed_documents"), findings, "row_id")


def local_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Findings under the line number their row has among the rows of its source."""
    lines = delivery.local_numbers(_rows(spark, folder), "source_identifier", "row_id").select(F.col("row_id").alias("row_number"), "source_identifier", F.col("local").alias("line_no"))
    return table(spark, folder, "audit_issues").distinct().join(lines, "row_number").select("source_identifier", "line_no", "issue_type")


def name_forms(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    return table(spark, folder, "batch_manifest").select("entry_id", delivery.name_slug(label).alias("slug"), delivery.safe_name(label).alias("file_name"), delivery.valid_name(label).alias("is_name"))


def batch_names(spark: SparkSession, folder: str) -> DataFrame:
    """A name of its own for every batch of a subject: history, history-2, ..."""
    first = _rows(spark, folder).groupBy("batch_id").agg(F.min_by(F.coalesce("subject", F.lit("")), "row_id").alias("subject"))
    named = first.select("batch_id", F.coalesce(F.nullif(delivery.name_slug(F.col("subject")), F.lit("")), F.lit("batch")).alias("name"))
    return delivery.unique_names(named, "name", "batch_id")


def clean_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "batch_manifest").select("entry_id", delivery.sanitized_query(F.col("source_url"), DROPPED).alias("url"))


def reviewable_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches with their label: the subject of the first row that has one, else the name."""
    subject = F.nullif(filled(F.col("subject")), F.lit(""))
    return _rows(spark, folder).groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.min_by(subject, F.when(subject.isNotNull(), F.col("row_id"))).alias("first")).select("batch_id", "n_rows", F.coalesce("first", "batch_id").alias("label"))


def batch_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """All batches, with rows or only listed: how far each is, and how its rows were finalised."""
    rows = _rows(spark, folder).select("batch_id", "row_id", "review_status")
    bad = audit.open_findings(table(spark, folder, "audit_issues")).where("final_verdict = 'INVALID'").groupBy(F.col("row_number").alias("row_id")).agg(F.count("*").alias("open"))
    per = rows.join(bad, "row_id", "left").groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"), F.sum((filled(F.col("review_status")) != "").cast("long")).alias("flagged"))
    listed = table(spark, folder, "batch_manifest").where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("entries"), F.count("source_url").alias("urls"))
    every = per.join(listed, "batch_id", "full").select("batch_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "open", "flagged", "entries", "urls")])
    flags = {"extracted": F.col("n_rows") > F.col("flagged"), "manual_review": F.col("flagged") > 0, "uploaded": F.col("urls") > 0}
    return every.select("batch_id", delivery.batch_status(flags).alias("status"), delivery.finalized(F.col("n_rows"), F.col("open"), F.col("flagged") == 0).alias("finalized"))


def listed_only(spark: SparkSession, folder: str) -> DataFrame:
    """Batches with rows, and those that only the manifest knows."""
    own = _rows(spark, folder).groupBy("batch_id").agg(F.count("*").alias("n")).withColumn("held", F.lit("rows"))
    known = table(spark, folder, "batch_manifest").where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("n")).withColumn("held", F.lit("manifest"))
    return own.unionByName(known.join(own, "batch_id", "left_anti"))


def fenced_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON of answers, in a fence for some kinds of events and within prose for the others."""
    answer = F.when(F.col("event_type") > "m", F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" and no more")))
    return table(spark, folder, "events").select("event_id", delivery.fenced_json(answer).alias("payload"))


def document_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_documents").where("markdown is not null").select("document_id", F.substring("markdown", 1, 400).alias("excerpt"), F.length("markdown").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (line_rebuild, block_rebuild, document_link_list, index_expansion, canonical_sources, sample_drafts, template_rows, citation_constraint, retryable_errors, verdict_issues, full_audit, local_lines, name_forms, batch_names, clean_urls, reviewable_batches, batch_statuses, listed_only, fenced_payloads, document_snippets)}

_LINES = r"""l AS (SELECT document_id, unnest(range(len(w))) AS line, unnest(w) AS whole FROM (SELECT document_id, string_split(markdown, chr(10)) AS w FROM parsed_documents WHERE markdown IS NOT NULL)),
    s AS (SELECT document_id, line, whole, unnest(range((length(whole) + 4) // 5)) AS k FROM l WHERE whole <> ''),
    p AS (SELECT *, substr(whole, k * 5 + 1, 5) AS t, k % 3 = 0 AND k > 0 AND NOT regexp_matches(substr(whole, k * 5, 1), '\s') AND NOT regexp_matches(substr(whole, k * 5 + 1, 1), '\s') AS apart, CASE WHEN starts_with(whole, '#') THEN 14.0 ELSE 10.0 END::DOUBLE AS size FROM s),
    j AS (SELECT document_id, line, regexp_replace(string_agg(CASE WHEN apart THEN ' ' ELSE '' END || t, '' ORDER BY k), '\s+$', '') AS text, avg(size) FILTER (regexp_matches(t, '\S')) AS size FROM p GROUP BY ALL)"""
_LINK = r"\[([^\]]*)\]\((https?://[^)\s]+)\)"
_LINKS = f"""a AS (SELECT document_id, unnest(regexp_extract_all(markdown, '{_LINK}', 2)) AS url, unnest(regexp_extract_all(markdown, '{_LINK}', 1)) AS label, unnest(range(len(regexp_extract_all(markdown, '{_LINK}', 2)))) AS pos FROM parsed_documents),
    links AS (SELECT document_id, url, min(pos) AS pos, arg_min({sql_strip("label")}, pos) AS label FROM a GROUP BY document_id, url)"""
_OPEN = "(SELECT DISTINCT * FROM audit_issues) WHERE NOT coalesce(suppressed, false) AND final_verdict = 'INVALID'"
_SLUG = lambda x: f"trim(substr(trim(regexp_replace(lower({sql_strip(x)}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-')"
_CELL = lambda x: f"(CASE WHEN lower({sql_strip(x)}) IN ('ap', 'advanced placement', 'ib', 'international baccalaureate', 'honors', 'honours', 'gcse', 'igcse', 'a-level', 'a level', 'as-level', 'as level', 'elementary school', 'middle school', 'high school') THEN '' ELSE {sql_strip(x)} END)"
_LOW, _HIGH = (f"try_cast(nullif(regexp_extract({_CELL('grade_number')}, '^\\s*(\\d{{1,2}})\\s*-\\s*(\\d{{1,2}})\\s*$', {i}), '') AS INT)" for i in (1, 2))
_NEXT = lambda x: f"CASE WHEN {sql_strip(x)} = '' THEN '' WHEN regexp_matches({sql_strip(x)}, '^-?[0-9]{{1,17}}$') THEN (try_cast({sql_strip(x)} AS BIGINT) + n - 1)::VARCHAR WHEN n = 1 THEN {sql_strip(x)} ELSE {sql_strip(x)} || ' ' || n END"
ORACLES = {
    "line_rebuild": f"WITH {_LINES} SELECT document_id, line, text, size FROM j",
    "block_rebuild": f"""WITH {_LINES}, b AS (SELECT document_id, line // 10 AS block, trim(coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (regexp_matches(text, '\\S')), ''), ' ') AS text, coalesce(avg(size), 0) AS size FROM j GROUP BY ALL)
        SELECT document_id, block, md5(text) AS digest, length(text) AS n_chars, round(size, 6) AS size FROM b""",
    "document_link_list": f"WITH {_LINKS} SELECT document_id, pos, url, label FROM links WHERE regexp_matches(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.(pdf|docx)$') AND NOT regexp_matches(lower(url) || ' ' || lower(label), '{'|'.join(NOISE)}')",
    "index_expansion": f"WITH {_LINKS} SELECT document_id, count(*) AS documents, count(*) >= 3 AS expanded FROM links GROUP BY 1",
    "canonical_sources": f"""WITH o AS (SELECT source_path, min(u) AS origin FROM (SELECT source_path, regexp_replace(metadata['url'], '[?#].*$', '') AS u FROM parsed_documents WHERE source_type = 'website') WHERE {sql_strip('u')} <> '' GROUP BY 1)
        SELECT row_id, coalesce(nullif({sql_strip('e.source')}, ''), origin, nullif({sql_strip("metadata['url']")}, ''), d.source_path) AS source FROM extracted_rows e LEFT JOIN parsed_documents d ON e.source_identifier = d.document_id LEFT JOIN o ON d.source_path = o.source_path""",
    "sample_drafts": f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) AS k FROM extracted_rows) WHERE k <= 30)
        SELECT batch_id, row_id, {_CELL('display_grade')} AS display_grade, CASE WHEN {_LOW} <= {_HIGH} AND {_HIGH} - {_LOW} <= 20 THEN array_to_string(range({_LOW}, {_HIGH} + 1), ',') ELSE {_CELL('grade_number')} END AS grade_number,
        CASE WHEN {sql_strip('domain')} = '' AND {sql_strip('topic')} <> '' THEN {sql_strip('topic')} ELSE {sql_strip('domain')} END AS domain, CASE WHEN {sql_strip('domain')} = '' AND {sql_strip('topic')} <> '' THEN '' ELSE {sql_strip('topic')} END AS topic,
        '' AS l4, '' AS standard_code, {sql_strip('description')} AS description FROM r""",
    "template_rows": f"WITH f AS (SELECT subject, arg_min({{'c': standard_code, 'g': grade_number}}, row_id) AS f FROM extracted_rows WHERE subject IS NOT NULL GROUP BY 1), e AS (SELECT subject, f.c AS c, f.g AS g, unnest(range(1, 11)) AS n FROM f) SELECT subject, n, {_NEXT('c')} AS standard_code, {_NEXT('g')} AS grade_number FROM e",
    "citation_constraint": f"SELECT row_id, batch_id, CASE WHEN {sql_strip('description')} <> '' THEN 'missing' ELSE 'unsupported' END AS gap FROM extracted_rows WHERE ({sql_strip('description')} <> '') <> ({sql_strip('description_source_citation')} <> '')",
    "retryable_errors": """SELECT coalesce(len(list_filter(errors, lambda e: regexp_matches(e, '(PORTKEY|GEMINI|OPENAI|ANTHROPIC)_API_KEY is not configured|Portkey support requires the ''portkey-ai'' package'))) > 0, false) AS by_errors, coalesce(retryable, false) AS noted, count(*) AS attempts, count(DISTINCT path) AS paths
        FROM (SELECT DISTINCT * FROM processing_state) GROUP BY 1, 2""",
    "verdict_issues": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY row_number ORDER BY coalesce(logged_at_utc, ''), coalesce(issue_type, ''), coalesce(column_name, ''), coalesce(issue_message, ''), coalesce(final_verdict, '')) AS k FROM audit_issues)
        SELECT row_number, final_verdict, CASE WHEN final_verdict IS DISTINCT FROM 'VALID' THEN coalesce(nullif({sql_strip('issue_message')}, ''), 'Rejected without a reason.') ELSE '' END AS issue FROM f WHERE k = 1""",
    "full_audit": f"""WITH d AS (SELECT DISTINCT document_id FROM parsed_documents WHERE regexp_matches(markdown, '\\S')), f AS (SELECT row_number, issue_type FROM {_OPEN}),
        k AS (SELECT row_id, {sql_strip('source_identifier')} = '' AS blank, d.document_id IS NOT NULL AS loaded FROM extracted_rows e LEFT JOIN d ON e.source_identifier = d.document_id)
        SELECT row_id, CASE WHEN blank THEN 'missing_source' ELSE 'source_load_error' END AS issue_type, 'INVALID' AS verdict FROM k WHERE blank OR NOT loaded
        UNION ALL SELECT row_id, issue_type, CASE WHEN issue_type IS NULL THEN 'VALID' ELSE 'INVALID' END FROM k LEFT JOIN f ON k.row_id = f.row_number WHERE NOT blank AND loaded""",
    "local_lines": "WITH n AS (SELECT row_id, source_identifier, row_number() OVER (PARTITION BY source_identifier ORDER BY row_id) + 1 AS line_no FROM extracted_rows) SELECT source_identifier, line_no, issue_type FROM (SELECT DISTINCT * FROM audit_issues) a JOIN n ON a.row_number = n.row_id",
    "name_forms": f"SELECT entry_id, {_SLUG('label')} AS slug, coalesce(nullif(trim(regexp_replace(coalesce(label, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'input') AS file_name, coalesce(regexp_matches(label, '^[a-zA-Z0-9][a-zA-Z0-9_-]*$'), false) AS is_name FROM batch_manifest",
    "batch_names": f"WITH f AS (SELECT batch_id, arg_min(coalesce(subject, ''), row_id) AS s FROM extracted_rows GROUP BY 1), n AS (SELECT batch_id, coalesce(nullif({_SLUG('s')}, ''), 'batch') AS name FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY batch_id) AS k FROM n) SELECT batch_id, name, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS unique_name FROM k",
    "clean_urls": r"""WITH q AS (SELECT entry_id, source_url AS u, regexp_extract(source_url, '^[^?#]*\?([^#]*)', 1) AS q FROM batch_manifest), k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('sample_row', 'ref')), '&') AS r FROM q)
        SELECT entry_id, CASE WHEN q = '' OR q IS NULL THEN u ELSE regexp_extract(u, '^([^?#]*)', 1) || CASE WHEN r = '' THEN '' ELSE '?' || r END || regexp_extract(u, '(#.*)$', 1) END AS url FROM k""",
    "reviewable_batches": f"SELECT batch_id, count(*) AS n_rows, coalesce(arg_min({sql_strip('subject')}, row_id) FILTER ({sql_strip('subject')} <> ''), batch_id) AS label FROM extracted_rows GROUP BY batch_id",
    "batch_statuses": f"""WITH b AS (SELECT row_number AS row_id, count(*) AS o FROM {_OPEN} GROUP BY 1), p AS (SELECT batch_id, count(*) AS n, sum(o) AS o, count(*) FILTER ({sql_strip('review_status')} <> '') AS g FROM extracted_rows LEFT JOIN b USING (row_id) GROUP BY 1),
        m AS (SELECT batch_id, count(source_url) AS u FROM batch_manifest WHERE batch_id IS NOT NULL GROUP BY 1),
        e AS (SELECT coalesce(p.batch_id, m.batch_id) AS batch_id, coalesce(n, 0) AS n, coalesce(o, 0) AS o, coalesce(g, 0) AS g, coalesce(u, 0) AS u FROM p FULL JOIN m ON p.batch_id = m.batch_id)
        SELECT batch_id, CASE WHEN n > g THEN 'extracted' WHEN g > 0 THEN 'manual_review' WHEN u > 0 THEN 'uploaded' ELSE 'new' END AS status, CASE WHEN n = 0 THEN 'missing_csv' WHEN o > 0 THEN 'failed_audit' WHEN g = 0 THEN 'approved_sample_ready' ELSE 'passed_audit' END AS finalized FROM e""",
    "listed_only": "SELECT batch_id, count(*) AS n, 'rows' AS held FROM extracted_rows GROUP BY 1 UNION ALL SELECT batch_id, count(*), 'manifest' FROM batch_manifest m WHERE batch_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM extracted_rows e WHERE e.batch_id = m.batch_id) GROUP BY 1",
    "fenced_payloads": "SELECT event_id, props AS payload FROM events",
    "document_snippets": "SELECT document_id, substr(markdown, 1, 400) AS excerpt, length(markdown) AS n_chars FROM parsed_documents WHERE markdown IS NOT NULL",
}
