"""Queries on documents and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import sql_list, sql_strip
from loomset.operators import documents as dx
from loomset.operators.codes import ordered_first
from loomset.sources.tables import table


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_documents")


def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("document_id", dx.outline(F.col("markdown")).alias("outline"))


def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = table(spark, folder, "documents").select("doc_id", F.posexplode(dx.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return pieces.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def chunk_halves(spark: SparkSession, folder: str) -> DataFrame:
    cut = table(spark, folder, "documents").select("doc_id", dx.halves(F.col("text")).alias("h")).where("h is not null")
    return cut.select("doc_id", F.length(F.col("h")[0]).alias("first_chars"), F.length(F.col("h")[1]).alias("second_chars"), F.md5(F.col("h")[0]).alias("digest"))


def region_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Each document from its second section on, up to the last one."""
    heads = F.filter(F.split("markdown", "\n"), lambda x: x.startswith("## "))
    docs = _parsed(spark, folder).select("document_id", "markdown", heads.alias("heads")).where("size(heads) >= 3")
    cut = dx.region(F.col("markdown"), F.col("heads")[1], F.element_at("heads", -1), F.array().cast("array<string>"), F.lit("medium"))
    return docs.select("document_id", F.length("markdown").alias("n_chars"), F.length(cut).alias("region_chars"), F.md5(cut).alias("digest"))


def review_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of its source that each document's rows are reviewed against."""
    rows = table(spark, folder, "extracted_rows").select(F.col("source_identifier").alias("document_id"), F.lower(F.coalesce(*[F.when(F.length(F.trim(c)) >= dx.ANCHOR_LENGTH, F.col(c)) for c in ("topic", "domain", "description")])).alias("anchor")).where("anchor is not null").distinct()
    merged = dx.windows(rows.join(_parsed(spark, folder).select("document_id", F.lower("markdown").alias("markdown")), "document_id"), "document_id", "markdown", "anchor")
    return merged.select("document_id", F.col("number").cast("long").alias("number"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


def review_slice(spark: SparkSession, folder: str) -> DataFrame:
    """What of each document its rows are reviewed against: all of it up to the budget or without a hit, else the windows."""
    rows = table(spark, folder, "extracted_rows").select(F.col("source_identifier").alias("document_id"), "description", "topic", "domain")
    spans = dx.review_slices(_parsed(spark, folder).select("document_id", "markdown"), rows, "document_id", "markdown", ["description", "topic", "domain"])
    return spans.select("document_id", *[F.col(c).cast("long").alias(c) for c in ("number", "begin", "end")])


def marker_detect(spark: SparkSession, folder: str) -> DataFrame:
    found = dx.row_markers(table(spark, folder, "documents"), "doc_id", "text")
    return found.groupBy("doc_id", "pattern").agg(F.count("*").alias("n_codes"), F.min("offset").cast("long").alias("first_offset"))


def section_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return dx.sections(dx.row_markers(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    return dx.row_markers(_parsed(spark, folder), "document_id", "markdown").select("document_id", "code")


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows extracted from a document against the row markers found in it."""
    target = _expected(spark, folder).groupBy("document_id").agg(F.count("*").alias("expected"))
    got = table(spark, folder, "extracted_rows").groupBy(F.col("source_identifier").alias("document_id")).agg(F.countDistinct("standard_code").alias("extracted"))
    share = F.round(F.col("extracted") * 100.0 / F.col("expected"), 1)
    status = F.when(F.col("expected").isNull(), "unverified").when(share < 90, "low").otherwise("ok")
    return got.join(target, "document_id", "left").select("document_id", "extracted", "expected", share.alias("percent"), status.alias("status"))


def missing_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Markers in a document that no extracted row of it bears, compared as whole codes."""
    rows = table(spark, folder, "extracted_rows").select(F.col("source_identifier").alias("document_id"), F.col("standard_code").alias("code"))
    return _expected(spark, folder).join(rows, ["document_id", "code"], "left_anti").select("document_id", "code")


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return dx.links(_parsed(spark, folder), "document_id", "markdown").select("document_id", F.col("pos").cast("long").alias("pos"), "url", "label")


def link_top1(spark: SparkSession, folder: str) -> DataFrame:
    """The link of each page that most looks like its document."""
    scored = dx.links(_parsed(spark, folder), "document_id", "markdown").withColumn("score", dx.link_score(F.col("url"), F.col("label")))
    best = ordered_first(scored.where("score > 0"), ["document_id"], [F.desc("score"), F.length("url"), F.col("pos")])
    return best.select("document_id", "url", F.col("score").cast("long").alias("score"))


def manifest_expand(spark: SparkSession, folder: str) -> DataFrame:
    """One entry for every reference of a batch, the first kept, with the name of its staged file."""
    rows = table(spark, folder, "batch_manifest").select("entry_id", "batch_id", F.trim("source_url").alias("reference")).where("reference != ''")
    first = rows.groupBy("batch_id", "reference").agg(F.min("entry_id").alias("entry_id"))
    return first.select("entry_id", "batch_id", "reference", F.col("reference").rlike("(?i)^https?://").alias("is_url"), dx.url_slug(F.col("reference")).alias("slug"))


def program_filter(spark: SparkSession, folder: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.regexp_extract(F.coalesce("source_url", F.lit("")), r"([^/]*)$", 1)))
    rows = table(spark, folder, "batch_manifest").withColumn("terms", F.split(F.lit("syllabus,mathematics,science"), ","))
    return rows.where(F.exists("terms", lambda t: hay.contains(t))).groupBy("batch_id").agg(F.count("*").alias("entries"), F.countDistinct("source_url").alias("urls"))


def text_assessment(spark: SparkSession, folder: str) -> DataFrame:
    """How much text the paragraphs of each document hold, and whether the document needs reading again."""
    parts = _parsed(spark, folder).select("document_id", F.explode(F.split("markdown", "\n\n")).alias("part")).withColumn("n", F.length(F.trim("part")))
    low = F.sum((F.col("n") < 80).cast("int"))
    agg = parts.groupBy("document_id").agg(F.count("*").alias("parts"), F.sum("n").alias("total"), F.sum((F.col("n") < 80).cast("int")).alias("low"))
    mean, share = F.round(F.col("total") / F.col("parts"), 1), F.round(F.col("low") / F.col("parts"), 3)
    return agg.select("document_id", "parts", "total", "low", mean.alias("mean"), share.alias("share"), ((F.col("total") / F.col("parts") < 80) | (F.col("low") / F.col("parts") >= 0.5)).alias("again"))


def source_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by file suffix and the parser that reads them."""
    suffix = F.lower(F.regexp_extract("source_name", r"(\.[A-Za-z0-9]+)$", 1))
    parser = F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").otherwise("website")
    return _parsed(spark, folder).groupBy(suffix.alias("suffix"), parser.alias("parser")).agg(F.count("*").alias("documents"), F.sum((parser != F.col("source_type")).cast("int")).alias("other_type"), F.sum(F.length("markdown")).alias("n_chars"))


def _markers_sql(source: str, key: str, text: str) -> str:
    seg, item = (p.replace("'", "''") for p in dx.MARKERS.values())
    return f"""m AS (SELECT {key}, {text} AS t, list_distinct(regexp_extract_all({text}, '{seg}', 1)) AS a, list_distinct(regexp_extract_all({text}, '{item}', 1)) AS b FROM {source} WHERE length({text}) >= 40),
        markers AS (SELECT {key}, pattern, code, strpos(t, code) - 1 AS "offset" FROM (SELECT {key}, t, CASE WHEN len(a) >= {dx.MARKER_MINIMUM} THEN 'segmented_code' ELSE 'line_item' END AS pattern, unnest(CASE WHEN len(a) >= {dx.MARKER_MINIMUM} THEN a WHEN len(b) >= {dx.MARKER_MINIMUM} THEN b ELSE [] END) AS code FROM m))"""


_LINKS_SQL = f"""l AS (SELECT document_id, unnest(regexp_extract_all(markdown, '{dx.LINK}', 2)) AS url, unnest(regexp_extract_all(markdown, '{dx.LINK}', 1)) AS label, unnest(range(len(regexp_extract_all(markdown, '{dx.LINK}', 2)))) AS pos FROM parsed_documents),
    links AS (SELECT document_id, url, min(pos) AS pos, arg_min({sql_strip('label')}, pos) AS label FROM l GROUP BY document_id, url)"""
_HAY = "(lower(url) || ' ' || lower(label))"
_SCORE = " + ".join([f"CASE WHEN contains(lower(label), 'download syllabus') THEN 6 ELSE 0 END", *[f"CASE WHEN contains({_HAY}, '{w}') THEN 3 ELSE 0 END" for w in dx.LINK_GOOD], *[f"CASE WHEN contains({_HAY}, '{w}') THEN -4 ELSE 0 END" for w in dx.LINK_BAD]])
_PARTS = "list_filter(string_split(regexp_extract(reference, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '')"
_NAMED = f"CASE WHEN len({_PARTS}) = 0 THEN regexp_extract(reference, '^[a-zA-Z]+://([^/?#]+)', 1) WHEN len({_PARTS}) >= 2 AND lower({_PARTS}[-1]) IN ({sql_list(dx.GENERIC)}) THEN {_PARTS}[-2] || '-' || {_PARTS}[-1] ELSE {_PARTS}[-1] END"
_REGION = "substr(markdown, strpos(markdown, h[2]))"
_HEAD = sql_strip("h[2]")
_FROM = f"substr(markdown, strpos(markdown, {_HEAD}))"
_STOP = f"strpos(substr({_FROM}, length({_HEAD}) + 1), {sql_strip('h[-1]')})"
_CUT = f"CASE WHEN {_STOP} > 0 THEN substr({_FROM}, 1, length({_HEAD}) + {_STOP} - 1) ELSE {_FROM} END"
_GOOD = f"length({sql_strip('cut')}) >= {dx.REGION_FLOOR} AND length({sql_strip('cut')}) >= floor(length(markdown) * {dx.REGION_SHARE})"

QUERIES = {f.__name__: f for f in (document_outline, chunk_pack, chunk_halves, region_slice, review_windows, review_slice, marker_detect, section_inventory, coverage_report, missing_markers, page_links, link_top1, manifest_expand, program_filter, text_assessment, source_formats)}
ORACLES = {
    "document_outline": f"SELECT document_id, substr(coalesce(array_to_string(list_transform(list_filter(string_split(markdown, chr(10)), lambda l: regexp_matches(l, '^\\s*#')), lambda l: regexp_replace(l, '\\s+$', '')), chr(10)), ''), 1, {dx.OUTLINE_CHARS}) AS outline FROM parsed_documents",
    "region_slice": f"""WITH d AS (SELECT document_id, markdown, list_filter(string_split(markdown, chr(10)), lambda x: starts_with(x, '## ')) AS h FROM parsed_documents),
        c AS (SELECT document_id, markdown, {_CUT} AS cut FROM d WHERE len(h) >= 3)
        SELECT document_id, length(markdown) AS n_chars, CASE WHEN {_GOOD} THEN length(cut) END AS region_chars, CASE WHEN {_GOOD} THEN md5(cut) END AS digest FROM c""",
    "review_windows": f"""WITH r AS (SELECT DISTINCT source_identifier AS document_id, lower(coalesce(CASE WHEN length(trim(topic, ' ')) >= 12 THEN topic END, CASE WHEN length(trim(domain, ' ')) >= 12 THEN domain END, CASE WHEN length(trim(description, ' ')) >= 12 THEN description END)) AS anchor FROM extracted_rows),
        n AS (SELECT r.document_id, lower(markdown) AS markdown, substr({sql_strip('anchor')}, 1, {dx.ANCHOR_CHARS}) AS needle FROM r JOIN parsed_documents d ON r.document_id = d.document_id WHERE anchor IS NOT NULL),
        s AS (SELECT DISTINCT document_id, greatest(0, strpos(markdown, needle) - 1 - {dx.HALF_WINDOW}) AS b, least(length(markdown), strpos(markdown, needle) - 1 + length(needle) + {dx.HALF_WINDOW}) AS e FROM n WHERE length(needle) >= {dx.ANCHOR_LENGTH} AND strpos(markdown, needle) > 0),
        w AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        i AS (SELECT *, sum(CASE WHEN b <= coalesce(reach, -1) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS number FROM w),
        g AS (SELECT document_id, number, min(b) AS b, max(e) AS e FROM i GROUP BY ALL),
        u AS (SELECT *, coalesce(sum(e - b + {len(dx.SEPARATOR)}) OVER (PARTITION BY document_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g)
        SELECT document_id, number::BIGINT AS number, b::BIGINT AS "begin", least(e, b + {dx.REVIEW_CHARS} - used)::BIGINT AS "end" FROM u WHERE used < {dx.REVIEW_CHARS}""",
    "review_slice": f"""WITH r AS (SELECT DISTINCT source_identifier AS document_id, CASE WHEN length({sql_strip('description')}) >= {dx.ANCHOR_LENGTH} THEN {sql_strip('description')} WHEN length({sql_strip('topic')}) >= {dx.ANCHOR_LENGTH} THEN {sql_strip('topic')} WHEN length({sql_strip('domain')}) >= {dx.ANCHOR_LENGTH} THEN {sql_strip('domain')} END AS anchor FROM extracted_rows),
        n AS (SELECT r.document_id, markdown, {sql_strip(f"substr(anchor, 1, {dx.ANCHOR_CHARS})")} AS needle FROM r JOIN parsed_documents d ON r.document_id = d.document_id WHERE anchor IS NOT NULL AND length(markdown) > {dx.REVIEW_CHARS}),
        s AS (SELECT DISTINCT document_id, greatest(0, strpos(markdown, needle) - 1 - {dx.HALF_WINDOW}) AS b, least(length(markdown), strpos(markdown, needle) - 1 + length(needle) + {dx.HALF_WINDOW}) AS e FROM n WHERE length(needle) >= {dx.ANCHOR_LENGTH} AND strpos(markdown, needle) > 0),
        w AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        i AS (SELECT *, sum(CASE WHEN b <= coalesce(reach, -1) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS number FROM w),
        g AS (SELECT document_id, number, min(b) AS b, max(e) AS e FROM i GROUP BY ALL),
        u AS (SELECT *, coalesce(sum(e - b + {len(dx.SEPARATOR)}) OVER (PARTITION BY document_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g)
        SELECT document_id, number::BIGINT AS number, b::BIGINT AS "begin", least(e, b + {dx.REVIEW_CHARS} - used)::BIGINT AS "end" FROM u WHERE used < {dx.REVIEW_CHARS}
        UNION ALL SELECT document_id, 1::BIGINT, 0::BIGINT, coalesce(length(markdown), 0)::BIGINT FROM parsed_documents d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.document_id = d.document_id)""",
    "marker_detect": f"""WITH {_markers_sql('documents', 'doc_id', 'text')} SELECT doc_id, pattern, count(*) AS n_codes, min("offset") AS first_offset FROM markers GROUP BY ALL""",
    "section_inventory": rf"WITH {_markers_sql('documents', 'doc_id', 'text')} SELECT doc_id, replace(regexp_replace(code, '[.\-][^.\-]*$', ''), '-', '.') AS section, count(*) AS n FROM markers GROUP BY ALL",
    "coverage_report": f"""WITH {_markers_sql('parsed_documents', 'document_id', 'markdown')}, t AS (SELECT document_id, count(*) AS expected FROM markers GROUP BY 1),
        g AS (SELECT source_identifier AS document_id, count(DISTINCT standard_code) AS extracted FROM extracted_rows GROUP BY 1)
        SELECT g.document_id, extracted, expected, round(extracted * 100.0 / expected, 1)::DOUBLE AS percent, CASE WHEN expected IS NULL THEN 'unverified' WHEN round(extracted * 100.0 / expected, 1) < 90 THEN 'low' ELSE 'ok' END AS status FROM g LEFT JOIN t ON g.document_id = t.document_id""",
    "missing_markers": f"WITH {_markers_sql('parsed_documents', 'document_id', 'markdown')} SELECT document_id, code FROM markers m WHERE NOT EXISTS (SELECT 1 FROM extracted_rows e WHERE e.source_identifier = m.document_id AND e.standard_code = m.code)",
    "page_links": f"WITH {_LINKS_SQL} SELECT document_id, pos, url, label FROM links",
    "link_top1": f"WITH {_LINKS_SQL}, s AS (SELECT *, {_SCORE} AS score FROM links), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, length(url), pos) AS k FROM s WHERE score > 0) SELECT document_id, url, score::BIGINT AS score FROM r WHERE k = 1",
    "manifest_expand": f"""WITH f AS (SELECT min(entry_id) AS entry_id, batch_id, trim(source_url, ' ') AS reference FROM batch_manifest WHERE trim(source_url, ' ') <> '' GROUP BY 2, 3),
        s AS (SELECT *, regexp_replace(regexp_replace({_NAMED}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS slug FROM f)
        SELECT entry_id, batch_id, reference, regexp_matches(reference, '(?i)^https?://') AS is_url, CASE WHEN slug = '' THEN 'input' ELSE slug END AS slug FROM s""",
    "program_filter": "SELECT batch_id, count(*) AS entries, count(DISTINCT source_url) AS urls FROM batch_manifest WHERE regexp_matches(lower(coalesce(label, '') || ' ' || regexp_extract(coalesce(source_url, ''), '([^/]*)$', 1)), 'syllabus|mathematics|science') GROUP BY batch_id",
    "text_assessment": """WITH p AS (SELECT document_id, length(trim(unnest(string_split(markdown, chr(10) || chr(10))), ' ')) AS n FROM parsed_documents)
        SELECT document_id, count(*) AS parts, sum(n)::BIGINT AS total, sum((n < 80)::INT)::BIGINT AS low, round(sum(n) / count(*), 1)::DOUBLE AS mean, round(sum((n < 80)::INT) / count(*), 3)::DOUBLE AS share, sum(n) / count(*) < 80 OR sum((n < 80)::INT) / count(*) >= 0.5 AS again FROM p GROUP BY document_id""",
    "source_formats": """WITH s AS (SELECT *, lower(regexp_extract(source_name, '(\\.[A-Za-z0-9]+)$', 1)) AS suffix FROM parsed_documents), p AS (SELECT *, CASE suffix WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' ELSE 'website' END AS parser FROM s)
        SELECT suffix, parser, count(*) AS documents, sum((parser <> source_type)::INT)::BIGINT AS other_type, sum(length(markdown))::BIGINT AS n_chars FROM p GROUP BY suffix, parser""",
}
