"""Row quality: deterministic fixes, guards and preflight checks on extracted rows.

All of it is column expressions, so a pass over the rows is one projection
without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import SPACE, collapse, filled, strip

#: The levels a grade_level may take.
LEVELS = ["Elementary School", "Middle School", "High School"]
#: Other names of each level, whole and as beginnings.
LEVEL_NAMES = {
    "Elementary School": (["elementary school", "elementary", "primary school", "primary", "k-5", "k-6"], ["elementary", "primary"]),
    "Middle School": (["middle school", "middle", "junior high", "junior high school", "middle years", "junior"], ["middle"]),
    "High School": (["high school", "high", "senior school", "senior years", "senior", "secondary school", "secondary"], ["high", "senior", "secondary"]),
}
#: Names of courses, which are no grades.
PROGRAMS = [
    "ap", "advanced placement", "ib", "international baccalaureate", "honors", "honours",
    "gcse", "igcse", "a-level", "a level", "as-level", "as level",
]
#: Fixed value: a structural marker before a heading.
PREFIX = r"(?i)^\s*(?:unit|topic|module|cluster|lesson|section|chapter)\s+[0-9]+[.:)\-]?[0-9]*\s*[:.\-]?\s*"
#: Traces of page layout in a value.
NOISE = r"(?i)\bN\.B\.\b|\bpage\s+\d+\b|^\s*\d+\s*$|^\s*continued\b|^\s*appendix\b|^\s*footer\b|^\s*header\b"
WIDEST_RANGE = 20
#: Characters by which a citation may exceed the value it supports.
CUT_OFF = 24


def numeric_range(column: Column, dashes: str = "-") -> Column:
    """'9-12' as '9,10,11,12'; null for anything but a rising range of at most 21 numbers."""
    pattern = rf"^\s*(\d{{1,2}})\s*[{dashes}]\s*(\d{{1,2}})\s*$"
    low, high = (F.regexp_extract(column, pattern, i).try_cast("int") for i in (1, 2))
    return F.when((low <= high) & (high - low <= WIDEST_RANGE), F.array_join(F.sequence(low, F.greatest(low, high)), ","))


def grade_cell(column: Column, expand: bool) -> Column:
    """A grade without course names and level names; ranges expanded on request."""
    text = filled(column)
    kept = F.when(F.lower(text).isin(PROGRAMS + [x.lower() for x in LEVELS]), F.lit("")).otherwise(text)
    return F.coalesce(numeric_range(kept), kept) if expand else kept


def grade_list(column: Column) -> Column:
    """A range or a comma list of one- or two-digit numbers in its plain form; null for the rest."""
    text = strip(column)
    listed = F.when(text.rlike(r"^\s*\d{1,2}\s*(?:,\s*\d{1,2}\s*)+$"), F.regexp_replace(text, r"\s+", ""))
    return F.coalesce(numeric_range(text, "-–—"), listed)


def grade_level(column: Column) -> Column:
    """The level a name stands for, null if none."""
    lowered = F.lower(strip(column))
    out = None
    for level, (names, beginnings) in LEVEL_NAMES.items():
        hit = lowered.isin(names)
        for beginning in beginnings:
            hit = hit | lowered.startswith(beginning)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def without_prefix(column: Column) -> Column:
    """A heading without 'Unit 3:' and the like, unless nothing would be left."""
    text = filled(column)
    rest = strip(F.regexp_replace(text, PREFIX, ""))
    return F.when(rest == "", text).otherwise(rest)


def topic_list(column: Column) -> Column:
    """'A | a | B' as 'A | B': the first spelling of every segment, in order; null without a bar."""
    parts = F.filter(F.transform(F.split(column, r"\|"), strip), lambda p: p != "")
    # Earlier segments are searched for the same spelling in lower case.
    first = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, F.lit(1), i), lambda q: F.lower(q) == F.lower(p)))
    return F.when(column.contains("|") & (F.size(parts) > 0), F.array_join(first, " | "))


def noisy(column: Column) -> Column:
    return strip(column).rlike(NOISE)


def cut_off(value: Column, citation: Column) -> Column:
    """The value ends in the middle, or its citation goes on for more than 24 characters."""
    return _cut(collapse(F.coalesce(value, F.lit(""))), collapse(F.coalesce(citation, F.lit(""))))


def _cut(text: Column, source: Column) -> Column:
    return (text != "") & (text.rlike(r"[,;/(\-–—]$") | (source.startswith(text) & (F.length(source) > F.length(text) + CUT_OFF)))


def loses_notation(value: Column, citation: Column) -> Column:
    """The citation has a character beyond ASCII that the value lacks."""
    special = F.regexp_extract_all(F.coalesce(citation, F.lit("")), F.lit(r"([^\x00-\x7F])"), F.lit(1))
    return F.exists(special, lambda c: ~F.coalesce(value, F.lit("")).contains(c))


def programmatic_fixes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Trim, normalise grades, level and topic; ``fixes`` lists what changed.

    Trimmed and improved values are columns of their own first, so that no
    expression is evaluated twice for a row.
    """
    # The sentences of the notes below, of the issue of `guarded` and of the issues of `preflight`.
    forms = {"grade_number": grade_list, "grade_level": grade_level, "topic": topic_list}
    work = rows.withColumns({f"trimmed {c}": strip(F.col(c)) for c in columns})
    work = work.withColumns({f"better {c}": forms[c](F.col(f"trimmed {c}")) for c in columns if c in forms})
    out, notes = {}, []
    for c in columns:
        trimmed = F.col(f"trimmed {c}")
        notes.append(F.when(trimmed != F.col(c), F.lit(f"Trimmed surrounding whitespace in '{c}'.")))
        if c not in forms:
            out[c] = trimmed
            continue
        new = F.col(f"better {c}")
        change = (new != "") & (new != trimmed)
        out[c] = F.when(change, new).otherwise(trimmed)
        notes.append(F.when(change, F.concat(F.lit(f"Normalized {c} '"), trimmed, F.lit("' to '"), new, F.lit("'."))))
    return work.withColumns({**out, "fixes": F.array_compact(F.array(*notes))}).drop(*[f"{k} {c}" for k in ("trimmed", "better") for c in columns])


def guarded(rows: DataFrame) -> DataFrame:
    """The last word on a row: clean grades and headings, a domain where a topic is, ``issues`` for the rest."""
    domain, topic = without_prefix(F.col("domain")), without_prefix(F.col("topic"))
    promote = (domain == "") & (topic != "")
    raw, level = filled(F.col("grade_level")), grade_level(F.col("grade_level"))
    issue = F.when((raw != "") & level.isNull(), F.concat(F.lit("grade_level '"), raw, F.lit(f"' is not one of {' / '.join(LEVELS)} and could not be mapped.")))
    return rows.withColumns(
        {
            "display_grade": grade_cell(F.col("display_grade"), expand=False),
            "grade_number": grade_cell(F.col("grade_number"), expand=True),
            "domain": F.when(promote, topic).otherwise(domain),
            "topic": F.when(promote, F.lit("")).otherwise(topic),
            "grade_level": F.coalesce(level, F.col("grade_level")),
            "issues": F.array_compact(F.array(issue)),
        }
    )


def preflight(rows: DataFrame, required: list[str], checked: list[str], citation: str | None = "description_source_citation") -> DataFrame:
    """``issues`` against the contract, in its order, each once.

    A bare number is noise in prose but the very content of a grade, so grade
    fields aren't searched for it.
    """
    read = dict.fromkeys([*required, *checked, "grade_level"])
    work = rows.withColumns({f"filled {c}": filled(F.col(c)) for c in read})
    found = [F.when(F.col(f"filled {c}") == "", F.lit(f"Required field '{c}' is blank.")) for c in required]
    found += [F.when(F.col(f"filled {c}").rlike(NOISE), F.lit(f"Field '{c}' appears contaminated by layout noise or extraction artifacts.")) for c in checked]
    if citation:
        value, source = F.col("description"), F.col(citation)
        work = work.withColumns({"plain value": collapse(F.coalesce(value, F.lit(""))), "plain source": collapse(F.coalesce(source, F.lit("")))})
        has = F.coalesce(value, F.lit("")) != ""
        found.append(F.when(has & _cut(F.col("plain value"), F.col("plain source")), F.lit("Description appears truncated relative to its supporting citation.")))
        found.append(F.when(has & loses_notation(value, source), F.lit("Description appears to lose symbols, notation, or multilingual characters present in the source citation.")))
    raw = F.col("filled grade_level")
    found.append(F.when((raw != "") & ~raw.isin(LEVELS), F.concat(F.lit(f"grade_level must be one of {', '.join(LEVELS)}; got '"), raw, F.lit("'."))))
    return work.withColumn("issues", F.array_distinct(F.array_compact(F.array(*found)))).drop(*[f"filled {c}" for c in read], "plain value", "plain source")


def review_status(issues: Column) -> tuple[Column, Column]:
    """('' or NEEDS_REVIEW, the issues in one string)."""
    return F.when(F.size(issues) > 0, F.lit("NEEDS_REVIEW")).otherwise(F.lit("")), F.array_join(issues, " | ")
