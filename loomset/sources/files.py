"""Files as tables: discovery, CSV in the spreadsheet dialect, DOCX, HTML links; and the sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of documents and of references to web pages.
DOCUMENTS, REFERENCES = [".pdf", ".docx"], [".url", ".webloc", ".txt"]
URL = r"https?://\S+"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARSED = "document_id string, source_path string, source_name string, source_type string, markdown string"


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, kind, content, fingerprint): supported files of a folder.

    A text file counts as a reference if it holds a URL.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").when(suffix.isin(REFERENCES), "website")
    rows = files.select("path", name.alias("name"), suffix.alias("suffix"), kind.alias("kind"), "content", F.sha2("content", 256).alias("fingerprint")).where("kind is not null")
    return rows.where((F.col("suffix") != ".txt") | F.decode("content", "UTF-8").rlike(URL))


def referenced_urls(files: DataFrame) -> DataFrame:
    """(path, url): the first URL of each reference file."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"<[^>]*>", " ")
    return files.where("kind = 'website'").select("path", F.regexp_extract(text, rf"({URL})", 1).alias("url")).where("url != ''")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with doubled quotes, line breaks in cells and perhaps a byte-order mark; blanks as ''; ``line_no`` from 2."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    filled = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns], F.col("_metadata.file_path").alias("file of"), F.monotonically_increasing_id().alias("place"))
    # Cells may hold line breaks, so a file is read by one task, in order; each file is numbered by itself.
    placed = filled.groupBy("file of").agg(F.min("place").alias("first of"))
    return filled.join(placed, "file of").withColumn("line_no", F.col("place") - F.col("first of") + 2).drop("file of", "place", "first of")


def write_csv(rows: DataFrame, path: str) -> None:
    """The same dialect, quotes only where needed."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _paragraph(element) -> str:
    text = "".join(t.text or "" for t in element.iter(f"{_W}t")).strip()
    style = element.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") if style is not None else "") or ""
    heading = re.fullmatch(r"[Hh]eading\s*(\d*)", name)
    if text and heading:
        return "#" * min(6, max(1, int(heading.group(1) or 2))) + " " + text
    return f"- {text}" if text and name.lower().startswith("list") else text


def _table(element) -> str:
    rows = [[" ".join(p for p in (_paragraph(x) for x in cell.iter(f"{_W}p")) if p) for cell in row.iter(f"{_W}tc")] for row in element.iter(f"{_W}tr")]
    if not rows:
        return ""
    body = rows[1:] or [[""] * len(rows[0])]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, body)])


def docx_markdown(content: bytes) -> str | None:
    """Paragraphs and tables of a DOCX in their order; null if it cannot be read."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    parts = [_table(x) if x.tag == f"{_W}tbl" else _paragraph(x) for x in (body if body is not None else []) if x.tag in (f"{_W}p", f"{_W}tbl")]
    return "\n\n".join(p for p in parts if p)


def parsed_docx(files: DataFrame) -> DataFrame:
    """Parsed documents of DOCX files, file by file inside tasks; unreadable ones have null markdown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"document_id": b["name"].str.replace(r"\.[^.]*$", "", regex=True), "source_path": b["path"], "source_name": b["name"], "source_type": "docx", "markdown": b["content"].map(docx_markdown)})

    return files.where("kind = 'docx'").select("path", "name", "content").mapInPandas(run, PARSED)


def html_links(html: Column) -> Column:
    """array<struct<href, label>>: the anchors of a page, labels without tags, in their order."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    href = lambda a: F.regexp_extract(a, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    label = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", ""), r"\s+", " "))
    return F.filter(F.transform(anchors, lambda a: F.struct(href(a).alias("href"), label(a).alias("label"))), lambda x: x["href"] != "")
