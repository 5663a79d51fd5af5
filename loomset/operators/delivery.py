"""From checked rows to what is delivered: sources, drafts, gates, statuses, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.text import filled, strip
from loomset.operators.numbering import numbered
from loomset.operators.row_quality import grade_cell

#: Suffixes of linked documents, and words of links that lead to none.
LINKED_SUFFIXES = [".pdf", ".docx"]
#: Errors after which a document may be tried again.
RETRYABLE = [
    "PORTKEY_API_KEY is not configured",
    "Portkey support requires the 'portkey-ai' package",
    "GEMINI_API_KEY is not configured",
    "OPENAI_API_KEY is not configured",
    "ANTHROPIC_API_KEY is not configured",
]
#: Columns that a draft leaves blank; rows of a sample.
DRAFT_BLANK = ["l4", "l5", "standard_code", "czi_standard_code"]
SAMPLE_ROWS = (10, 30)
#: The statuses of a batch, the first that holds counts.
STATUSES = ["extracted", "manual_review", "approved_ready", "draft_ready", "uploaded", "new"]
#: Fixed value: documents that an index page must list to be expanded.
INDEX_DOCUMENTS = 3
#: Fixed value: share of a character's width from which a gap between spans is a blank.
BLANK_SHARE = 0.25


def joined_lines(spans: DataFrame, line: list[str]) -> DataFrame:
    """(line, text, size): spans put together in their order, with a blank where a real gap lies between two.

    ``spans`` has span, text, x0, x1 and size.  A blank is only added where
    neither side has one; ``size`` is the mean over spans that aren't blank.
    """
    order = Window.partitionBy(*line).orderBy("span")
    rows = spans.where("text != ''")
    width = (F.col("x1") - F.col("x0")) / F.length("text")
    open_ = F.lag("text").over(order).rlike(r"\s$") | F.col("text").rlike(r"^\s")
    gap = (F.col("x0") - F.lag("x1").over(order) > BLANK_SHARE * width) & ~open_
    rows = rows.withColumn("piece", F.concat(F.when(F.coalesce(gap, F.lit(False)), " ").otherwise(""), "text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(*line).agg(F.regexp_replace(whole, r"\s+$", "").alias("text"), F.avg(F.when(F.col("text").rlike(r"\S"), F.col("size"))).alias("size"))


def blocks_of(lines: DataFrame, block: list[str], line: str) -> DataFrame:
    """(block, text, size): the lines of a block that aren't blank, one below the other."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").rlike(r"\S"), F.struct(line, "text")))), lambda x: x["text"]), "\n")
    return lines.groupBy(*block).agg(F.trim(text).alias("text"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("size"))


def document_links(links: DataFrame, key: str, noise: list[str]) -> DataFrame:
    """Of (key, pos, url, label) those that lead to a document and hold no noise word."""
    path = F.regexp_extract(F.lower("url"), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    hay = F.concat(F.lower("url"), F.lit(" "), F.lower("label"))
    ends = reduce(Column.__or__, [path.endswith(s) for s in LINKED_SUFFIXES])
    noisy = reduce(Column.__or__, [hay.contains(w) for w in noise])
    return links.where(ends & ~noisy)


def index_pages(links: DataFrame, key: str, least: int = INDEX_DOCUMENTS) -> DataFrame:
    """(key, documents, expanded): pages that link documents, and whether they are enough for an index."""
    return links.groupBy(key).agg(F.count("*").alias("documents")).withColumn("expanded", F.col("documents") >= least)


def stamped_sources(rows: DataFrame, documents: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows with a blank ``source`` filled: the URL a staged file came from, else the page's own, else the path.

    ``rows`` has document_id and source, ``documents`` document_id, path and url, ``origins`` path and origin.
    """
    first = origins.where(filled(F.col("origin")) != "").groupBy("path").agg(F.min("origin").alias("origin"))
    known = documents.join(first, "path", "left").select("document_id", F.coalesce("origin", F.nullif(filled(F.col("url")), F.lit("")), "path").alias("canonical"))
    return rows.join(known, "document_id", "left").withColumn("source", F.coalesce(F.nullif(filled(F.col("source")), F.lit("")), "canonical")).drop("canonical")


def draft_rows(rows: DataFrame, batch: str, number: str, target: int = SAMPLE_ROWS[1]) -> DataFrame:
    """The first rows of every batch as a draft: some columns blank, grades in order, a domain where a topic is.

    The first rows are found per batch and part of the table first, so that no
    batch is sorted in one task.
    """
    target = max(SAMPLE_ROWS[0], min(SAMPLE_ROWS[1], target))
    part = F.pmod(F.xxhash64(number), F.lit(64))
    for group in ([F.col(batch), part], [F.col(batch)]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(number))).where(F.col("place") <= target)
    forms = {"display_grade": grade_cell(F.col("display_grade"), False), "grade_number": grade_cell(F.col("grade_number"), True)}
    out = {c: F.lit("") if c in DRAFT_BLANK else forms.get(c, filled(F.col(c))) for c in rows.columns if c not in (batch, number, "place")}
    domain, topic = filled(F.col("domain")), filled(F.col("topic"))
    up = (domain == "") & (topic != "")
    return rows.withColumns({**out, "domain": F.when(up, topic).otherwise(domain), "topic": F.when(up, F.lit("")).otherwise(topic)}).drop("place")


def expanded_example(value: Column, index: Column) -> Column:
    """The ``index``-th example after the first: whole numbers count on, other text is numbered."""
    text = filled(value)
    return F.when(text == "", F.lit("")).when(text.rlike(r"^-?[0-9]{1,17}$"), (text.try_cast("long") + index - 1).cast("string")).when(index == 1, text).otherwise(F.concat(text, F.lit(" "), index.cast("string")))


def citation_gaps(value: Column, citation: Column) -> Column:
    """'missing' where a value has no citation, 'unsupported' where a citation has no value, else null."""
    has, cited = filled(value) != "", filled(citation) != ""
    return F.when(has & ~cited, "missing").when(cited & ~has, "unsupported")


def retryable(errors: Column) -> Column:
    """True if an error is one of those that pass when the configuration changes."""
    return F.coalesce(F.exists(errors, lambda e: reduce(Column.__or__, [e.contains(m) for m in RETRYABLE])), F.lit(False))


def batch_status(flags: dict[str, Column]) -> Column:
    """The first status of ``STATUSES`` whose flag is true."""
    return F.coalesce(*[F.when(flags[s], s) for s in STATUSES if s in flags], F.lit(STATUSES[-1]))


def finalized(rows: Column, open_findings: Column, approved: Column) -> Column:
    """missing_csv without rows, failed_audit with an open finding, approved_sample_ready or passed_audit."""
    return F.when(rows == 0, "missing_csv").when(open_findings > 0, "failed_audit").when(approved, "approved_sample_ready").otherwise("passed_audit")


def first_verdicts(findings: DataFrame, number: str, order: list[Column]) -> DataFrame:
    """One verdict a row, the first by ``order``, with the issues it stands for: its message, or a sentence where it has none."""
    first = findings.groupBy(number).agg(F.min_by(F.struct("final_verdict", "issue_message"), F.struct(*order)).alias("v"))
    message = F.coalesce(F.nullif(filled(F.col("v.issue_message")), F.lit("")), F.lit("Rejected without a reason."))
    return first.select(number, F.col("v.final_verdict").alias("final_verdict"), F.when(~F.col("v.final_verdict").eqNullSafe("VALID"), message).otherwise("").alias("issue"))


def audited(rows: DataFrame, documents: DataFrame, findings: DataFrame, number: str) -> DataFrame:
    """(number, issue_type, verdict) of the full audit, one row for each issue of a row.

    ``rows`` has document_id; every source is looked up once.  A row without one
    has ``missing_source``, a row of a source that can't be read one
    ``source_load_error``, the others their open findings, or none.
    """
    readable = documents.where(F.col("markdown").rlike(r"\S")).select("document_id", F.lit(True).alias("loaded")).distinct()
    sources = rows.select("document_id").where(filled(F.col("document_id")) != "").distinct().join(readable, "document_id", "left")
    known = rows.join(sources, "document_id", "left")
    blank = filled(F.col("document_id")) == ""
    off = known.where(blank | F.col("loaded").isNull()).select(number, F.when(blank, "missing_source").otherwise("source_load_error").alias("issue_type"))
    own = known.where(~blank & F.col("loaded").isNotNull()).join(findings.select(number, "issue_type"), number, "left").select(number, "issue_type")
    out = off.unionByName(own)
    return out.withColumn("verdict", F.when(F.col("issue_type").isNull(), "VALID").otherwise("INVALID"))


def local_numbers(rows: DataFrame, source: str, number: str) -> DataFrame:
    """(number, source, local): the line of every row among the rows of its source, from 2 on.

    """
    return numbered(rows.select(number, source), source, number, "local", 2)


def name_slug(value: Column, longest: int = 60) -> Column:
    """Lower case, everything but letters and digits as one hyphen, at most 60 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(filled(value)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, longest), "^-+|-+$", "")


def safe_name(value: Column, otherwise: str = "input") -> Column:
    """A file name of plain characters."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit(otherwise))


def valid_name(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-zA-Z0-9][a-zA-Z0-9_-]*$"), F.lit(False))


def unique_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """``names`` with ``unique_name``: the second of a name gets -2 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return names.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def sanitized_query(url: Column, dropped: list[str]) -> Column:
    """A URL without some parameters of its query."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(dropped))
    rest = F.array_join(kept, "&")
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(query == "", url).otherwise(F.concat(head, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)), tail))


def fenced_json(text: Column) -> Column:
    """What stands in the first code fence, else the text from its first brace to its last."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return strip(F.when(fence != "", fence).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))
