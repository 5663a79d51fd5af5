"""Column helpers for text, each with an SQL twin for tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space character of Unicode; the notation is understood by Java and RE2 alike.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The same characters one by one.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(column, F.lit(SPACES))


def filled(column: Column) -> Column:
    """Stripped text, with null as the empty string."""
    return strip(F.coalesce(column, F.lit("")))


def collapse(column: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(column, rf"{SPACE}+", " "))


def any_of(values: list[str]) -> str:
    """A regular expression for any of the plain values."""
    return "|".join(f"(?:{''.join(c if c.isalnum() or c == ' ' else chr(92) + c for c in v)})" for v in values)


def sql_strip(sql: str) -> str:
    return f"regexp_replace(coalesce({sql}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
