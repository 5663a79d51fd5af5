"""Queries on the quality of extracted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import SPACE, filled, sql_list, sql_strip
from loomset.operators import row_quality as rq
from loomset.operators.fix_loop import fix_loop as run_fix_loop
from loomset.sources.tables import table

FIELDS = ["grade_level", "grade_number", "domain", "topic", "description"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_rows")


def grade_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("row_id", rq.grade_cell(F.col("display_grade"), False).alias("display_grade"), rq.grade_cell(F.col("grade_number"), True).alias("grade_number"), rq.grade_list(F.col("grade_number")).alias("grade_list"))


def grade_level_map(spark: SparkSession, folder: str) -> DataFrame:
    level = rq.grade_level(F.col("grade_level"))
    return _rows(spark, folder).groupBy(F.coalesce(level, F.lit("")).alias("level")).agg(F.count("*").alias("n_rows"), F.countDistinct("grade_level").alias("n_names"))


def heading_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("row_id", rq.without_prefix(F.col("domain")).alias("domain"), rq.without_prefix(F.col("topic")).alias("topic"))


def topic_segments(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.concat_ws(" | ", "topic", F.upper("topic"), "domain", "l3")
    return _rows(spark, folder).select("row_id", rq.topic_list(joined).alias("topics"))


def row_guards(spark: SparkSession, folder: str) -> DataFrame:
    out = rq.guarded(_rows(spark, folder))
    status, issues = rq.review_status(F.col("issues"))
    return out.select("row_id", "display_grade", "grade_number", "domain", "topic", "grade_level", status.alias("review_status"), issues.alias("review_issues"))


def programmatic_fixes(spark: SparkSession, folder: str) -> DataFrame:
    out = rq.programmatic_fixes(_rows(spark, folder).select("row_id", *FIELDS), FIELDS)
    return out.select("row_id", *FIELDS, F.array_join("fixes", " ").alias("fixes"))


def preflight_issues(spark: SparkSession, folder: str) -> DataFrame:
    out = rq.preflight(_rows(spark, folder), ["source", "domain", "description"], ["domain", "topic", "description"])
    return out.select("row_id", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"))


def text_flags(spark: SparkSession, folder: str) -> DataFrame:
    d, c = F.col("description"), F.col("description_source_citation")
    return _rows(spark, folder).where(d.isNotNull()).select(
        "row_id",
        rq.noisy(d).alias("noisy"),
        rq.cut_off(d, F.concat(d, c)).alias("cut_off"),
        rq.loses_notation(c, d).alias("loses_notation"),
        (d.contains("\n") & ~F.coalesce(c.contains("\n"), F.lit(False))).alias("loses_lines"),
    )


LOOP = ["row_id", "source", "grade_level", "display_grade", "grade_number", "domain", "topic", "description"]


def fix_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Two passes over the rows: programmatic fixes, then the guards for what still fails."""
    rows = _rows(spark, folder).select(*LOOP)
    first = lambda df: rq.programmatic_fixes(df, [c for c in LOOP if c != "row_id"]).select(*LOOP)
    second = lambda df: rq.guarded(df).select(*LOOP)
    check = lambda df: rq.preflight(df, ["source", "domain", "description"], ["domain", "topic", "description"], citation=None)
    return run_fix_loop(rows, [first, second], check).select("row_id", "domain", "grade_level", "review_status", "review_issues", "passes")


def _sql_range(x: str, dashes: str) -> str:
    p = rf"^\s*(\d{{1,2}})\s*[{dashes}]\s*(\d{{1,2}})\s*$"
    low, high = (f"try_cast(nullif(regexp_extract({x}, '{p}', {i}), '') AS INT)" for i in (1, 2))
    return f"CASE WHEN {low} <= {high} AND {high} - {low} <= {rq.WIDEST_RANGE} THEN array_to_string(range({low}, {high} + 1), ',') END"


def _sql_cell(x: str, expand: bool) -> str:
    kept = f"(CASE WHEN lower({sql_strip(x)}) IN ({sql_list(rq.PROGRAMS + [v.lower() for v in rq.LEVELS])}) THEN '' ELSE {sql_strip(x)} END)"
    return f"coalesce({_sql_range(kept, '-')}, {kept})" if expand else kept


def _sql_list_of(x: str) -> str:
    s = sql_strip(x)
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce({_sql_range(s, '-–—')}, CASE WHEN regexp_matches({s}, '^\\s*\\d{{1,2}}\\s*(?:,\\s*\\d{{1,2}}\\s*)+$') THEN regexp_replace({s}, '\\s+', '', 'g') END) END"


def _sql_level(x: str) -> str:
    s = f"lower({sql_strip(x)})"
    cases = " ".join(f"WHEN {s} IN ({sql_list(names)}) OR {' OR '.join(f'starts_with({s}, {sql_list([b])})' for b in begin)} THEN '{level}'" for level, (names, begin) in rq.LEVEL_NAMES.items())
    return f"(CASE {cases} END)"


def _sql_heading(x: str) -> str:
    s = sql_strip(x)
    return f"coalesce(nullif({sql_strip(f'regexp_replace({s}, {sql_list([rq.PREFIX])}, {sql_list([str()])})')}, ''), {s})"


def _sql_topics(x: str) -> str:
    """Order-keeping distinct on the lower form: a segment stays if no earlier one equals it."""
    parts = f"list_filter(list_transform(string_split({x}, '|'), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    return f"(CASE WHEN contains({x}, '|') AND len({parts}) > 0 THEN array_to_string(list_filter({parts}, lambda p, i: list_position(list_transform({parts}, lambda q: lower(q)), lower(p)) = i), ' | ') END)"


_COLLAPSE = lambda x: sql_strip(f"regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g')")


def _sql_cut(v: str, c: str) -> str:
    a, b = _COLLAPSE(v), _COLLAPSE(c)
    return f"({a} <> '' AND (regexp_matches({a}, '[,;/(\\-–—]$') OR (starts_with({b}, {a}) AND length({b}) > length({a}) + {rq.CUT_OFF})))"


def _sql_notation(v: str, c: str) -> str:
    return f"(len(list_filter(regexp_extract_all(coalesce({c}, ''), '[^\\x00-\\x7F]'), lambda ch: NOT contains(coalesce({v}, ''), ch))) > 0)"


_NOISE = f"regexp_matches({{}}, '{rq.NOISE}')"
_GUARD_ISSUE = f"CASE WHEN {sql_strip('grade_level')} <> '' AND {_sql_level('grade_level')} IS NULL THEN 'grade_level ''' || {sql_strip('grade_level')} || ''' is not one of {' / '.join(rq.LEVELS)} and could not be mapped.' ELSE '' END"


def _sql_fixes() -> str:
    cols, notes = [], []
    for c in FIELDS:
        t = f"CASE WHEN {c} IS NOT NULL THEN {sql_strip(c)} END"
        notes.append(f"CASE WHEN {sql_strip(c)} <> {c} THEN 'Trimmed surrounding whitespace in ''{c}''.' END")
        new = {"grade_number": _sql_list_of, "grade_level": _sql_level, "topic": _sql_topics}.get(c)
        if not new:
            cols.append(f"{t} AS {c}")
            continue
        n = new(c) if c != "topic" else _sql_topics(sql_strip(c))
        changed = f"({n} <> '' AND {n} <> {sql_strip(c)})"
        cols.append(f"CASE WHEN {c} IS NOT NULL AND {changed} THEN {n} ELSE {t} END AS {c}")
        notes.append(f"CASE WHEN {c} IS NOT NULL AND {changed} THEN 'Normalized {c} ''' || {sql_strip(c)} || ''' to ''' || {n} || '''.' END")
    return f"SELECT row_id, {', '.join(cols)}, concat_ws(' ', {', '.join(notes)}) AS fixes FROM extracted_rows"


def _sql_preflight() -> str:
    d, c = "description", "description_source_citation"
    issues = [f"CASE WHEN {sql_strip(x)} = '' THEN 'Required field ''{x}'' is blank.' END" for x in ("source", "domain", d)]
    issues += [f"CASE WHEN {_NOISE.format(sql_strip(x))} THEN 'Field ''{x}'' appears contaminated by layout noise or extraction artifacts.' END" for x in ("domain", "topic", d)]
    issues += [f"CASE WHEN coalesce({d}, '') <> '' AND {_sql_cut(d, c)} THEN 'Description appears truncated relative to its supporting citation.' END"]
    issues += [f"CASE WHEN coalesce({d}, '') <> '' AND {_sql_notation(d, c)} THEN 'Description appears to lose symbols, notation, or multilingual characters present in the source citation.' END"]
    issues += [f"CASE WHEN {sql_strip('grade_level')} <> '' AND {sql_strip('grade_level')} NOT IN ({sql_list(rq.LEVELS)}) THEN 'grade_level must be one of {', '.join(rq.LEVELS)}; got ''' || {sql_strip('grade_level')} || '''.' END"]
    return f"WITH i AS (SELECT row_id, unnest([{', '.join(issues)}]) AS issue FROM extracted_rows) SELECT issue, count(*) AS n_rows, min(row_id) AS first_row FROM i WHERE issue IS NOT NULL GROUP BY issue"


_DOMAIN, _TOPIC = _sql_heading("domain"), _sql_heading("topic")
QUERIES = {f.__name__: f for f in (grade_cells, grade_level_map, heading_prefixes, topic_segments, row_guards, programmatic_fixes, preflight_issues, text_flags, fix_loop)}
ORACLES = {
    "grade_cells": f"SELECT row_id, {_sql_cell('display_grade', False)} AS display_grade, {_sql_cell('grade_number', True)} AS grade_number, {_sql_list_of('grade_number')} AS grade_list FROM extracted_rows",
    "grade_level_map": f"SELECT coalesce({_sql_level('grade_level')}, '') AS level, count(*) AS n_rows, count(DISTINCT grade_level) AS n_names FROM extracted_rows GROUP BY 1",
    "heading_prefixes": f"SELECT row_id, {_DOMAIN} AS domain, {_TOPIC} AS topic FROM extracted_rows",
    "topic_segments": f"SELECT row_id, {_sql_topics('j')} AS topics FROM (SELECT row_id, concat_ws(' | ', topic, upper(topic), domain, l3) AS j FROM extracted_rows)",
    "row_guards": f"""SELECT row_id, {_sql_cell('display_grade', False)} AS display_grade, {_sql_cell('grade_number', True)} AS grade_number,
        CASE WHEN {_DOMAIN} = '' AND {_TOPIC} <> '' THEN {_TOPIC} ELSE {_DOMAIN} END AS domain,
        CASE WHEN {_DOMAIN} = '' AND {_TOPIC} <> '' THEN '' ELSE {_TOPIC} END AS topic,
        coalesce({_sql_level('grade_level')}, grade_level) AS grade_level,
        CASE WHEN {_GUARD_ISSUE} <> '' THEN 'NEEDS_REVIEW' ELSE '' END AS review_status, {_GUARD_ISSUE} AS review_issues FROM extracted_rows""",
    "programmatic_fixes": _sql_fixes(),
    "preflight_issues": _sql_preflight(),
    "text_flags": f"""SELECT row_id, {_NOISE.format(sql_strip('description'))} AS noisy, {_sql_cut('description', 'description || description_source_citation')} AS cut_off,
        {_sql_notation('description_source_citation', 'description')} AS loses_notation, contains(description, chr(10)) AND NOT coalesce(contains(description_source_citation, chr(10)), false) AS loses_lines
        FROM extracted_rows WHERE description IS NOT NULL""",
}
